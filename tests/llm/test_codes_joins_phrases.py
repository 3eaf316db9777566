"""Vector codes, the n-gram join and phrases against plain loops, and their odd cases."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_brute import WORD, groups

from heronwatch.llm import jaccard, phrases, queries, vector_codes

DOCS = "doc_id long, text string, lang string"


def coded(rows, parts=8, entries=16, rounds=6, scale=4096):
    """The contract of op11 in plain Python: every entry compared, no search."""
    good = [(i, [int(Fraction(x) * scale // 1) for x in v], lab) for i, v, lab in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    good.sort(key=lambda r: r[0])
    step = len(good[0][1]) // parts
    cut = lambda v, p: v[p * step : (p + 1) * step]
    books = [[cut(v, p) for _, v, _ in good[:entries]] for p in range(parts)]

    def near(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        found = [[near(v, p)[1] for p in range(parts)] for _, v, _ in good]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), c in zip(good, found, strict=True) if c[p] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out, total = {}, Counter()
    for i, v, lab in good:
        best = [near(v, p) for p in range(parts)]
        out[i] = ("".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), lab)
        total[lab] += out[i][1]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return {i: (c, d, total[lab], sha) for i, (c, d, lab) in out.items()}


def vectors(n, width=16, seed=1):
    r = random.Random(seed)
    rows = [(i, [float(np.float32(r.gauss(0, 0.2))) for _ in range(width)], r.choice([None, 0, 1, 1, 1])) for i in range(3, n + 3)]
    return rows + [(0, None, 1), (1, [0.1, None] * (width // 2), 1), (2, [float("nan")] + [0.0] * (width - 1), 2), (n + 3, [float("inf")] * width, None), (n + 4, [0.0] * width, 1), (n + 5, [0.0] * width, 1)]


def test_op11(spark):
    rows = vectors(120)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("code", "error", "bare")})
    got = {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.compress(table.repartition(5)).collect()}
    assert got == coded(rows)


def test_op11_odd_tables(spark):
    schema = "vec_id long, embedding array<double>, label int"
    assert vector_codes.compress(spark.createDataFrame([], schema)).count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, [], 1), (2, None, None), (3, [1.0] * 9, 1)], schema)).count() == 0
    few = [(i, [i * 1e6 + k for k in range(8)], None) for i in range(5)]  # fewer rows than entries, squares over 64 bits in the search
    few += [(9, [1e300] + [0.0] * 7, None)]
    got = {r.vec_id: (r.code, r.codebooks_sha256) for r in vector_codes.compress(spark.createDataFrame(few, schema)).collect()}
    assert got == {i: (c, s) for i, (c, _, _, s) in coded(few).items()}


def test_equal_average_search_is_exact():
    r = np.random.default_rng(5)
    for width in (1, 2, 8):
        parts, book = r.integers(-4, 5, (400, width)), r.integers(-4, 5, (16, width))
        far = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
        index, best = vector_codes.nearest(parts, book)
        assert (index == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()
        index, best = vector_codes.nearest(parts.astype(object) * 10**20, book.astype(object) * 10**20)
        assert (index == far.argmin(axis=1)).all() and (best == far.min(axis=1).astype(object) * 10**40).all()


def test_codes_decode(spark):
    rows, starts, width = vector_codes.usable(spark.createDataFrame([(i, [float(i)] * 8, 0) for i in range(16)], "vec_id long, embedding array<float>, label int"))
    books = vector_codes.codebooks(rows, starts, width)
    for r in vector_codes.decoded(vector_codes.coded(rows, books, width), books).collect():
        assert r.decoded == [float(r.vec_id)] * 8


def test_op12(spark, small):
    texts = {i: t or "" for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet' ORDER BY 1").fetchall()}
    want, sizes = groups(texts, 3, 90)
    got = queries.op12_prefix_join(spark, small).collect()
    assert {r.doc_id: r.component_id for r in got} == want and {r.doc_id: r.n_shingles for r in got} == sizes


def crowd(seed=2):
    """Near copies of one text in chains, texts that share most of it and are no copies, exact copies."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(10**6)}"
    base = [word() for _ in range(200)]
    texts = {}
    for i in range(150):
        t = list(base)
        for _ in range(r.choice([1, 2, 3, 5, 8])):
            t[r.randrange(200)] = word()
        texts[i] = " ".join(t)
    for i in range(150, 170):
        texts[i] = texts[i - 150]
    for i in range(170, 200):
        texts[i] = " ".join(base[:100] + [word() for _ in range(100)])
    return texts


@pytest.mark.parametrize("block", [7, 1_000])
def test_op12_in_a_crowd(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = crowd()
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts.items()], DOCS).repartition(6)
    want, sizes = groups(texts, 3, 90)
    got = jaccard.join(docs, 3, 90).collect()
    assert {r.doc_id: r.component_id for r in got} == want and {r.doc_id: r.n_shingles for r in got} == sizes


def test_op12_all_links(spark):
    texts = crowd(3)
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts.items()], DOCS)
    grams = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, w in ((i, WORD.findall(t)) for i, t in texts.items())}
    first = {}
    for i, g in grams.items():
        first.setdefault(frozenset(g), i)
    ids = sorted(first.values())
    want = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 100 * len(grams[a] & grams[b]) >= 90 * len(grams[a] | grams[b])}
    assert len(want) > 100 and {(r.a, r.b) for r in jaccard.links(docs, 3, 90).collect()} == want


def test_op12_odd_rows(spark):
    long = " ".join(f"x{i % 5000}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (6, "one two three"), (7, long), (8, long + " end"), (None, "one two"), (9, "solo"), (9, "solo"), (10, "é É"), (11, "É É"), (12, "a b c d"), (12, "one two")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], DOCS).withColumns({c: F.lit(0) for c in ("node", "shingle", "component", "s1")})
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs, 3, 90).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 5000, 7), (8, 5001, 7), (None, 1, None), (9, 1, 9), (9, 1, 9), (10, 1, 10), (11, 1, 11), (12, 2, 4), (12, 1, 4)], key=str
    )
    assert jaccard.join(docs.limit(0), 3, 90).count() == 0


def mined(rows, least, longest, top, percent=80):
    """The contract of op13 in plain Python."""
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    out = {}
    often = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    for (lang, p), a in often.items():
        score, k, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        holds = [b for (other, q), b in often.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if not any(100 * b >= percent * a for b in holds):
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, r): (p.decode(), -a, left, right, n[lang], -s) for lang, all_ in out.items() for r, (s, a, p, left, right) in enumerate(sorted(all_)[:top], 1)}


@pytest.mark.parametrize("least, longest, top, shards", [(30, 4, 2_000, 10), (3, 4, 7, 10), (2, 3, 50, 16), (5, 2, 9, 1)])
def test_op13(spark, small, least, longest, top, shards):
    rows = duckdb.sql(f"SELECT doc_id, text, lang FROM '{small}/documents.parquet' WHERE doc_id < 60").fetchall()
    rows += [(1000, "A b. a B,a b\tc\va b", None), (1001, "a b a b a b", "und"), (1002, None, "en"), (1003, " ,.", "en"), (None, "x y x y x y", "zz"), (1005, "a b " * 40_000, "zz")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("shard", "key", "phrase", "n", "f")})
    got = {(r.lang, r.rank): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(docs.repartition(4), least, longest, top, shards=shards).collect()}
    assert got == mined(rows, least, longest, top)


def test_op13_empty(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).count() == 0
