"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing column names."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronwatch.llm import bpe, html_text, line_quality, lookup_sketch, masked_lm, minhash, mixing, passages, shards, suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i * 7919 % 100_003}" for i in range(60_000))
BODY = " ".join(f"b{i * 31 % 997}" for i in range(120))
ROWS = [
    (1, BODY, "en", "a"), (2, BODY, "en", "a"), (3, BODY + " tail", "en", None), (4, None, "en", "b"), (5, "", None, "b"), (6, " \n\t ", "en", "b"), (7, LONG, "en", "c"), (8, "x", "en", "c"),
    (None, BODY, "en", "a"), (9, "één   naïve 日本 👩‍👩‍👧", "fr", "c"), (10, "same same " * 50, "en", "b"), (10, "same same " * 50, "en", "b"), (11, "before " + LONG, "en", "c"), (12, "one two", "en", "b"), (13, "one two", "en", "b"),
]
CLASH = ["key", "tag", "spans", "_id", "_text", "size", "rank", "id", "in_0", "labels", "u", "component", "_order", "hash", "n"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return rows.withColumns({c: F.lit(None).cast("string") for c in CLASH})


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def test_quality(docs):
    got = {r.doc_id: r for r in line_quality.query(docs).collect()}
    assert len(got) == 14 and got[4].n_words == 0 and got[4].base_failed and not got[5].kept and got[7].n_words == 60_000
    assert got[1].kept and got[10].n_repeat_words == 100 and not got[10].kept and got[9].word_chars == len("".join(WORD.findall(ROWS[9][1])))
    kept = line_quality.keep(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 7, 11, None}


def test_near_duplicates(docs):
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, words=4).collect()}
    assert got[1].component_id == got[2].component_id == got[3].component_id == 1 and got[11].component_id == 7 and got[13].component_id == 12
    assert got[4].n_shingles == got[6].n_shingles == 0 and got[8].n_shingles == 1 and got[4].kept and got[None].component_id is None and got[None].kept
    kept = minhash.keep(docs, words=4)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7, 8, 9, 10, 10, 12]


def brute(rows, units, join):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        u, new = units(t or ""), set()
        gone = bytearray(len(u))
        for p in range(len(u) - 49):
            w = hash(tuple(u[p : p + 50]))
            if w in seen and seen[w] != i:
                gone[p : p + 50] = b"\1" * 50
            elif w not in seen:
                new.add(w)
        seen |= dict.fromkeys(new, i)
        out.setdefault(i, []).append((len(u), sum(gone), hashlib.sha256(join(x for x, g in zip(u, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize(("module", "units", "join", "n"), [(passages, lambda t: t.encode().split(), b" ".join, "n_words"), (suffixes, lambda t: list(t.encode()), bytes, "n_bytes")])
def test_repeats(docs, module, units, join, n):
    want = brute([r[:2] for r in ROWS], units, join)
    got = {}
    for r in module.query(docs).collect():
        got.setdefault(r.doc_id, []).append((r[n], r.n_removed, r.kept_sha256))
    assert got == want


def test_passages_cut(docs):
    kept = passages.keep(docs)
    got = {r.doc_id: r for r in kept.collect()}
    assert kept.columns == docs.columns and 2 not in got and got[3].text == "tail" and got[3].n_chars == 4 and got[11].text.strip() == "before" and got[1].text == BODY and got[4].text is None


def test_mixture(docs):
    rows = mixing.query(docs).collect()
    assert len(rows) == len(ROWS) and all(r.taken <= 3 * r["size"] for r in rows)
    kept = mixing.keep(docs)
    assert kept.columns == docs.columns and kept.where("source IS NULL").count() <= 3


def test_bpe(docs, tokenizer):
    got = {r.doc_id: r for r in bpe.digests(docs, *tokenizer).collect()}
    assert got[4].n_tokens == 0 and all(r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for i, t, *_ in ROWS for r in [got[i]])
    back = bpe.decode(bpe.encode(docs.where("doc_id < 7 OR doc_id = 9"), *tokenizer, offsets="spans"), *tokenizer)
    assert all(r.decoded == (r.text or "") and len(r.spans) == len(r.token_ids) for r in back.collect())


def test_bpe_splits_and_offsets(docs, tokenizer):
    own = bpe.Coder(*tokenizer)
    odd = ["", "naïve 日本語 \U0001f9ff\U0001f9ff x", "\u0000\u00ad\u0120Ġ é", "\U00013000" * 3, "a" * 5000 + "ß", "  \n\n\t 12345678 don't"]
    for text in odd + [t or "" for _, t, *_ in ROWS]:
        ids, raw = own.encode(text), text.encode()
        assert own.decode(ids) == raw
        want = own.library.encode(text, add_special_tokens=False)
        assert [tuple(x) for x in own.offsets(ids, raw).tolist()] == want.offsets and np.frombuffer(ids, "<u4").tolist() == want.ids
    split = own.encode("\U00013000")
    assert len(split) > 4 and len({tuple(x) for x in own.offsets(split, "\U00013000".encode()).tolist()}) == 1


def test_bpe_table_is_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_CHARACTERS", 50)
    own = bpe.Coder(*tokenizer)
    for i in range(40):
        assert own.decode(own.encode(f"w{i}" * 30)) == (f"w{i}" * 30).encode()
    assert own.held <= 50 + 30 * 3 * 2


def test_shards(docs):
    rows = shards.by_bytes(docs).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.shard < 16 and r.law == "bytes" for r in rows)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_sketches(docs):
    rows = lookup_sketch.query(docs).collect()
    texts = [t or "" for _, t, *_ in sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0))]
    assert len(rows) == len(ROWS)
    got = {r.doc_id: r for r in rows}
    edited = BODY[: len(BODY) - len(BODY) // 2] + BODY[: len(BODY) // 2]
    assert got[1].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[1].fingerprint == got[2].fingerprint == got[None].fingerprint
    assert got[1].near_next == 1.0 and got[4].near_next == 1.0 and got[4].n_chars == 0 and got[7].near_next == 0.0 and texts[3] == ""


def test_scores(docs):
    got = {r.doc_id: r for r in masked_lm.score(docs).collect()}
    assert got[4].n_words == 0 and got[4].mean_log_likelihood is None and got[7].n_words == 60_000 and got[7].log_likelihood < 0 and got[1].log_likelihood == pytest.approx(got[2].log_likelihood)


def test_pages(spark):
    rows = [(1, "http://h/a", "<div class=x>menu</div><p>one &amp; <b>t</b>wo</p>"), (2, None, None), (3, "h", ""), (1, "http://h/a", "<div class=x>menu</div><p>one &amp; <b>t</b>wo</p>"), (None, "http://h/b", "<p>" + "y" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "hash", "page", "hashes", "n")})
    got = html_text.extract(pages).collect()
    assert sorted(((r.page_id or 0), r.n_chars) for r in got) == [(0, 200_000), (1, 14), (1, 14), (2, 0), (3, 0)]


def test_empty_tables(spark, docs, tokenizer):
    none = docs.where("false")
    for f in (line_quality.query, minhash.near_duplicates, passages.query, suffixes.query, mixing.query, shards.by_bytes, lookup_sketch.query, masked_lm.score, line_quality.keep, minhash.keep, passages.keep, mixing.keep):
        assert f(none).count() == 0, f
    assert bpe.digests(none, *tokenizer).count() == 0
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(("module", "units", "join", "n"), [(passages, lambda t: t.encode().split(), b" ".join, "n_words"), (suffixes, lambda t: list(t.encode()), bytes, "n_bytes")])
def test_repeats_with_hot_grams(spark, docs, monkeypatch, module, units, join, n):
    """Windows of grams that many documents have are dealt out one by one, with the same result."""
    from heronwatch.llm import repeats

    monkeypatch.setattr(repeats, "SAMPLE_OF", 1)
    monkeypatch.setattr(repeats, "HOT_IN_SAMPLE", 2)
    line = " ".join(f"common{k}" for k in range(55))
    rows = [r[:2] for r in ROWS] + [(100 + i, f"{i} own words {i * i} {line} and {i % 4} more {line if i % 5 == 0 else ''}") for i in range(40)]
    want, got = brute(rows, units, join), {}
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(repeats.hot_grams(repeats.keyed(table), module.SHAPE)) > 0
    for r in module.query(table).collect():
        got.setdefault(r.doc_id, []).append((r[n], r.n_removed, r.kept_sha256))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_spans_are_maximal_runs(spark):
    part = "".join(chr(97 + k * 7 % 26) + str(k) for k in range(40))
    rows = [(1, f"{part}..{part[::-1]}"), (2, f"{part[:60]} between {part[::-1][:70]}{part[5:75]}")]
    got = {r.doc_id: r for r in suffixes.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone, text = bytearray(len(rows[1][1])), rows[1][1]
    for p in range(len(text) - 49):
        if text[p : p + 50] in rows[0][1]:
            gone[p : p + 50] = b"\1" * 50
    want = len([x for x in bytes(gone).split(b"\0") if x])
    assert got[2].n_spans == want > 1 and got[2].n_removed == sum(gone) and got[1].n_spans == 0


def test_round_trip(docs, tokenizer):
    rows = bpe.round_trip(docs, *tokenizer).collect()
    assert len(rows) == len(ROWS) and all(r.decoded_same and r.n_tokens == len(r.token_ids) for r in rows) and {r.n_tokens for r in rows if r.doc_id in (4, 5)} == {0}


def test_overfull_ranges_are_divided(docs, monkeypatch):
    want = {(r.doc_id, r.text_crc32): r["size"] for r in shards.by_bytes(docs).collect()}
    monkeypatch.setattr(shards, "OVERFULL", 0.01)
    monkeypatch.setattr(shards, "SAMPLES_PER_RANGE", 0.05)
    rows = shards.by_bytes(docs).collect()
    assert len(rows) == len(ROWS) and {(r.doc_id, r.text_crc32): r["size"] for r in rows} == want
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows))) for s in {r.shard for r in rows})


def test_repeated_rows_share_their_copies(spark):
    rows = [(1, "a b c", "x")] * 7 + [(2, "d e f", "x"), (3, "g h i " * 50, "y"), (4, "j k l " * 40, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {}
    for r in mixing.query(docs).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    kept = {}
    for r in mixing.keep(docs).collect():
        kept[r.doc_id] = kept.get(r.doc_id, 0) + len(r.text.split())
    assert kept == {i: n for i, n in taken.items() if n}


def test_pipeline_over_odd_rows(spark, docs, tmp_path):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and all(r.decoded_same for r in rows) and {r.doc_id for r in rows} <= {1, 3, 7, 11, None}
    docs.where("false").select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_largest_doc_id_is_not_null(spark):
    top = (1 << 63) - 1
    docs = spark.createDataFrame([(top, "a b c\nd"), (None, "e f g"), (3, "h i j")], "doc_id long, text string")
    for f in (passages.query, suffixes.query, lookup_sketch.query):
        assert {r.doc_id for r in f(docs).collect()} == {top, None, 3}, f
