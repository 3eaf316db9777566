"""What operators exchange: everything, in a form that is not larger than it need be."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronwatch.llm import jaccard, masked_lm, passages, repeats, suffixes


@pytest.mark.parametrize("module", [suffixes, passages])
def test_runs_are_exchanged_packed(spark, module):
    """The runs of op9 and op7 come back whole from rows that are smaller than their contents."""
    rng = np.random.default_rng(3)
    words = [f"{a}{b}" for a in ("stone", "river", "light", "under", "over") for b in ("s", "ed", "ing", "less", "ward", "line")]
    passage = [" ".join(rng.choice(words, 120)) for _ in range(20)]
    texts = {i: f"{' '.join(rng.choice(words, 60))} {passage[i % 20]} {' '.join(rng.choice(words, 60))}" for i in range(400)}
    docs = repeats.keyed(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)).cache()
    rows = repeats.runs(docs, repeats.shared_anchors(docs, module.SHAPE, 256), module.SHAPE, 4).where(F.col("packed").isNotNull()).collect()
    sent = contents = 0
    for r in rows:
        for run in repeats._unpacked_runs(bytes(r.packed)).to_pylist():
            own = texts[run["key"]] if module is suffixes else texts[run["key"]].split()
            for k in run["at"]:
                part = own[k : k + run["n"] + module.SHAPE.window - 1]
                assert run["content"].decode() == (part if module is suffixes else " ".join(part))
            contents += len(run["content"])
        sent += len(r.packed)
    assert contents > 100_000 and sent < contents / 2


def test_chance_sharing_leaves_lists(spark, monkeypatch):
    """Lists of op12 keep the sets that can be similar, not those that share an n-gram by chance;
    links stay those of brute force, with lists taken as short or long."""
    rng = np.random.default_rng(8)
    texts = [[f"w{x}" for x in rng.integers(0, 25, rng.integers(40, 300))] for _ in range(500)]
    texts += [t[:-1] + ["end"] for t in texts[:30]]
    sets = [{tuple(t[k : k + 3]) for k in range(len(t) - 2)} for t in texts]
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    own = jaccard._Sets(docs, 3, 90)
    assert len(want) >= 30 and {i for pair in want for i in pair} <= {r.node for r in own.lists.select("node").collect()}
    assert own.cells.count() < len(texts) / 2
    assert {(r.a, r.b) for r in jaccard.links(docs, 3, 90).collect()} == want
    monkeypatch.setattr(jaccard, "SHORT", 2)
    assert jaccard._Sets(docs, 3, 90).cells.count() > len(texts) / 2
    assert {(r.a, r.b) for r in jaccard.links(docs, 3, 90).collect()} == want


@pytest.mark.parametrize("wide", [1.0, 300.0])
def test_softmax_shifts_a_batch_once(wide):
    """op4's softmax takes no maximum of each row where logits are close; far apart they stay finite and right."""
    rng = np.random.default_rng(6)
    y = rng.normal(0, wide, (500, 72)).astype(np.float32)
    y[:, 0] += np.linspace(-wide, wide, 500)
    at, shifted = rng.integers(0, 72, 500), y.copy()
    masked_lm._shift(shifted)
    assert (len(np.unique((y - shifted).round(2))) == 1) == (wide == 1.0)
    exact = y.astype(float) - y.max(axis=1, keepdims=True)
    exact -= np.log(np.exp(exact).sum(axis=1, keepdims=True))
    assert np.allclose(masked_lm._log_softmax_at(y.copy(), at), exact[np.arange(500), at], rtol=1e-4, atol=1e-4)
    want = np.exp(exact)
    want[np.arange(500), at] -= 1
    assert np.allclose(masked_lm._softmax_less(y.copy(), at, 500), want / 500, atol=1e-8, rtol=1e-3)
