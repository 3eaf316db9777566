"""Scores held against plain loops over the same weights, and against what both sides tell."""

import math
from collections import Counter

import numpy as np
import pytest

from heronwatch.llm import masked_lm as lm


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(2)
    words = [f"w{i}" + "x" * (i % 9) for i in range(7000)]
    return [" ".join(words[k] for k in np.minimum(rng.zipf(1.3, 120), 6999)) for _ in range(300)] + [" ".join(words[3000:7000])]


def plain(net, words, known, counts, rare):
    """Sum of the log-probabilities of ``words``, one by one."""
    kind = [known.get(w, lm.KNOWN + min(len(w), 15) // 2) for w in words]
    total = 0.0
    for i, k in enumerate(kind):
        z = np.zeros(lm.HIDDEN)
        for j, d in enumerate([-3, -2, -1, 1, 2, 3]):
            z += net.embed[kind[i + d] if 0 <= i + d < len(kind) else lm.KINDS - 1] * net.scale[j]
        h = np.append(np.maximum(z, 0), 1.0)
        y = h @ net.out
        total += y[k // lm.GROUP if k < lm.KNOWN else k - lm.KNOWN + lm.GROUPS] - math.log(np.exp(y).sum())
        if k < lm.KNOWN:
            y = h @ net.inner[k // lm.GROUP]
            total += y[k % lm.GROUP] - math.log(np.exp(y).sum())
        else:
            total += math.log(counts[words[i]] / rare[k - lm.KNOWN])
    return total


def test_scores_are_those_of_plain_loops(spark, corpus):
    docs = spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string").coalesce(1)
    every = lm.counts(docs.select("text")).cache()
    vocab = lm.vocabulary(every)
    net = lm.train(docs.select("text"), vocab)
    counts = Counter(w for t in corpus for w in t.split())
    hashes = {w: int(lm.words_in(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0]) for w in counts}
    rank = dict(zip(vocab.hashes.tolist(), vocab.kinds.tolist(), strict=True))
    known = {w: rank[h] for w, h in hashes.items() if h in rank}
    assert len(known) == lm.KNOWN < len(counts) == every.count()
    rare = [sum(n for w, n in counts.items() if w not in known and min(len(w), 15) // 2 == g) for g in range(lm.LENGTHS)]
    assert rare == vocab.rare.tolist()
    got = {r.doc_id: r for r in lm.score(docs).collect()}
    for i in (0, 17, 299, 300):
        assert got[i].n_words == len(corpus[i].split()) and got[i].log_likelihood == pytest.approx(plain(net, corpus[i].split(), known, counts, rare), rel=1e-4)


def test_gradients(corpus):
    """One step with a tiny rate moves every part against its numerical gradient."""
    rng = np.random.default_rng(4)
    net = lm.Network(*(rng.normal(0, 0.4, s) for s in ((lm.KINDS, lm.HIDDEN), (2 * lm.REACH, lm.HIDDEN), (lm.HIDDEN + 1, lm.GROUPS + lm.LENGTHS), (lm.GROUPS, lm.HIDDEN + 1, lm.GROUP))))
    around, kind = rng.integers(0, lm.KINDS, (2 * lm.REACH, 40)), rng.integers(0, lm.KINDS - 1, 40)
    loss = lambda: -net.log_probabilities(around, kind).mean()
    trainer, seen = lm.Trainer(net), {}
    trainer._move = lambda part, weights, at, gradient: seen.setdefault(part, []).append((at, gradient))
    trainer.step(around, kind)
    row = int(np.flatnonzero(seen[0][0][0] == around[2, 5])[0])
    g, inner = seen[3][0]
    for weights, at, want in ((net.embed, (around[2, 5], 3), seen[0][0][1][row, 3]), (net.scale, (1, 4), seen[1][0][1][1, 4]), (net.out, (2, 7), seen[2][0][1][2, 7]), (net.inner, (g, 5, 9), inner[5, 9])):
        old = weights[at]
        weights[at] = old + 1e-3
        up = loss()
        weights[at] = old - 1e-3
        down = loss()
        weights[at] = old
        assert (up - down) / 2e-3 == pytest.approx(want, rel=0.05, abs=2e-4)


def test_every_position_is_trained(spark):
    """Texts of two words of their own: the vector of each moves only where the other is trained."""
    docs = spark.createDataFrame([(f"x{i} y{i}",) for i in range(2000)], "text string").coalesce(1)
    vocab = lm.vocabulary(lm.counts(docs))
    moved = (lm.train(docs, vocab).embed != lm.Network.start(vocab).embed).any(axis=1)
    assert moved[:4000].all()
