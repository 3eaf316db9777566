"""Phrase collocations by SON partitioning.

The corpus is dealt into ``SHARDS`` shards by a hash of doc_id; each is mined completely at a
support lowered to its share of the text: a phrase with the whole support has that much in one
shard at least, whatever the shares. A shard is as many tasks as it fills: they count their own
phrases as hashes, which are added up by shard and hash. One and two words are mined first; longer
phrases only where all their word pairs are frequent in some shard. The union of locally frequent
phrases, a set of hashes in a filter of fixed size, then says which phrases of 1 to ``longest``
words are counted globally, as strings: collisions and chance hits of the filter only add phrases
that the exact count drops again.

Phrases lie within pieces of a text; everything is per lang, a null lang being ``und`` like the
lang of that name. Null and blank texts have no words; very long texts count whole, and repeated
rows count each. Rows without doc_id are one group of a shard. Phrases of equal score come in the
order of their counts, then of their bytes. An empty table gives an empty result. Columns other
than doc_id, text and lang play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import pieces, released
from .bits import Filter
from .hashing import BYTE_VALUES, MULT, U, chunks, lower_ascii, mix, prefix, ranges, text_buffers, word_bounds, word_hashes
from .storage import materialize

LEAST, LONGEST, TOP, INSIDE_PERCENT = 30, 4, 2_000, 80
#: Shards: few, so that a shard's support stays above one; a power of two of them fits in a key.
SHARDS, SHARD_BITS, LEVEL_BITS = 10, 4, 3
#: Hashes that a task adds up at a time, sums that it hands on at a time, bytes of text that it counts at a time.
HELD, SENT, COUNTED = 1_000_000, 100_000, 1 << 20
#: Bytes: in a word, between words, between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = 1
_KIND[[*b".,;:!?", 10, 11, 12, 13]] = 2
_OTHER_VALUES = mix(BYTE_VALUES) | U(1)


class Words:
    """The words of some texts, and the hashes of their phrases by number of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, twice: bool = False):
        self.data = lower_ascii(data)
        kind = _KIND[data]
        self.start, self.end, self.row = word_bounds(self.data, offsets, kind == 0)
        pieces_before = np.cumsum(kind == 2, dtype=np.int64)[self.start] if len(data) else np.zeros(0, np.int64)
        self.joined = (pieces_before[1:] == pieces_before[:-1]) & (self.row[1:] == self.row[:-1])
        self.first = langs[self.row]
        self.word = word_hashes(self.data, self.start, self.end)
        self.other = mix(ranges(prefix(_OTHER_VALUES[self.data]), self.start, self.end)) if twice else None

    def grams(self, longest: int, of: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, hash of k words from each place on, which of them lie in one piece)."""
        word = self.word if of is None else of
        hashed, whole = self.first.copy(), np.ones(len(word), bool)
        for k in range(1, longest + 1):
            n = max(0, len(word) - k + 1)
            hashed = hashed[:n] * U(MULT) + word[k - 1 :]
            whole = whole[:n] if k == 1 else whole[:n] & self.joined[k - 2 :]
            yield k, mix(hashed + U(k)), whole


def _source(docs: DataFrame, shards: int) -> DataFrame:
    shard = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(shards)).cast("int")
    return docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), shard.alias("shard"))


def _lang_hashes(column: pa.Array) -> np.ndarray:
    data, offsets = text_buffers(column)
    return word_hashes(data, offsets[:-1], offsets[1:])


def _passing(words: Words, longest: int, known: Filter | None, filtered: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, hashes, mask) where phrases up to ``filtered`` words must be in ``known``, and longer
    ones only have such parts."""
    before = None
    for k, hashed, whole in words.grams(longest):
        ok = whole if before is None else whole & before[:-1] & before[1:]
        if known is not None and (1 < k <= filtered or filtered == longest):
            at = np.flatnonzero(ok)
            ok = np.zeros(len(ok), bool)
            ok[at] = known.has(hashed[at] >> U(SHARD_BITS + LEVEL_BITS))
        yield k, hashed, ok
        before = ok


def _mined(source: DataFrame, levels: range, known: Filter | None, supports: list[int]) -> DataFrame:
    """key (hash, number of words and shard) of the phrases that are frequent in a shard."""
    sent = source.sparkSession.sparkContext.broadcast(known.bits) if known else None
    low = (1 << (SHARD_BITS + LEVEL_BITS)) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = Filter(sent.value) if sent else None
        held, n = [], 0

        def added() -> Iterator[pa.RecordBatch]:
            keys, times = np.unique(np.concatenate(held), return_counts=True)
            for a in range(0, len(keys), SENT):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + SENT].view(np.int64)), pa.array(times[a : a + SENT].astype(np.int64))], names=["key", "n"])

        for batch in pieces(batches, 0):
            data, offsets = text_buffers(batch.column(0))
            langs = _lang_hashes(batch.column(1))
            shards = batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint64)
            for a, b in chunks(offsets):
                words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], langs[a:b])
                for k, hashed, ok in _passing(words, levels[-1], have, 2):
                    if k in levels:
                        own = shards[a:b][words.row[: len(ok)][ok]]
                        held.append((hashed[ok] & U(~low & (1 << 64) - 1)) | U(k << SHARD_BITS) | own)
                        n += len(held[-1])
                if n >= HELD:
                    yield from added()
                    held, n = [], 0
        if n:
            yield from added()
        released()

    counts = source.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    support = F.element_at(F.array(*[F.lit(s) for s in supports]), (F.col("key").bitwiseAND((1 << SHARD_BITS) - 1) + 1).cast("int"))
    return materialize(counts.where(F.col("n") >= support).select("key"))


def _filter(keys: DataFrame) -> Filter:
    return Filter.of(keys.select(F.shiftrightunsigned("key", SHARD_BITS + LEVEL_BITS)))


def _counted(source: DataFrame, longest: int, known: Filter) -> DataFrame:
    """(lang, phrase, k, f) of the phrases in ``known``, counted over all texts; k = 0 counts all
    words of a lang."""
    sent = source.sparkSession.sparkContext.broadcast(known.bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = Filter(sent.value)
        for batch in pieces(batches, 0, COUNTED):
            data, offsets = text_buffers(batch.column(0))
            langs = _lang_hashes(batch.column(1))
            words = Words(data, offsets, langs, twice=True)
            raw = words.data.tobytes()
            rows, phrases, sizes, times = [], [], [], []
            seconds = (hashed for _, hashed, _ in words.grams(longest, words.other))
            for (k, hashed, ok), second in zip(_passing(words, longest, have, longest), seconds, strict=True):
                at = np.flatnonzero(ok)
                order = at[np.lexsort((second[at], hashed[at]))]
                new = np.ones(len(order), bool)
                new[1:] = (hashed[order][1:] != hashed[order][:-1]) | (second[order][1:] != second[order][:-1])
                first = np.flatnonzero(new)
                at = order[first]
                rows.append(words.row[at])
                times.append(np.diff(np.append(first, len(order))))
                sizes.append(np.full(len(at), k))
                start, end = words.start[at], words.end[at + k - 1]
                plain = np.ones(len(at), bool)  # one space between all its words
                for j in range(k - 1):
                    gap = words.end[at + j]
                    plain &= (words.start[at + j + 1] == gap + 1) & (words.data[np.minimum(gap, len(raw) - 1)] == 32)
                for i, a, b, p in zip(at.tolist(), start.tolist(), end.tolist(), plain.tolist(), strict=True):
                    phrases.append(raw[a:b] if p else b" ".join(raw[words.start[i + j] : words.end[i + j]] for j in range(k)))
            total, one = np.bincount(words.row, minlength=batch.num_rows), np.zeros(batch.num_rows, np.int64)
            rows, sizes, times = [*rows, np.arange(batch.num_rows)], [*sizes, one], [*times, total]
            text = pa.array(phrases, pa.binary()).cast(pa.string())
            text = pa.concat_arrays([text, pa.array([""] * batch.num_rows, pa.string())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(pa.array(np.concatenate(rows))), text, pa.array(np.concatenate(sizes).astype(np.int32)), pa.array(np.concatenate(times).astype(np.int64))],
                names=["lang", "phrase", "k", "f"],
            )
        released()

    return source.mapInArrow(run, "lang string, phrase string, k int, f long").groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f"))


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS) -> DataFrame:
    """(lang, phrase, k, f) of all phrases of 1 to ``longest`` words with f >= ``least``, and the
    number of words of each lang at k = 0."""
    if not 1 <= shards <= 1 << SHARD_BITS or not 2 <= longest < 1 << LEVEL_BITS:
        raise ValueError(f"shards must be 1 to {1 << SHARD_BITS}, longest 2 to {(1 << LEVEL_BITS) - 1}")
    source = _source(docs, shards)
    sizes = {r.shard: r.n for r in source.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("n")).collect()}  # a row for each shard
    total = max(1, sum(sizes.values()))
    supports = [max(1, math.ceil(least * sizes.get(s, 0) / total)) for s in range(shards)]
    short = _filter(_mined(source, range(1, 3), None, supports))
    known = short | _filter(_mined(source, range(3, longest + 1), short, supports)) if longest > 2 else short
    return materialize(_counted(source, longest, known).where((F.col("k") == 0) | (F.col("f") >= least)))


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of every phrase of two words or more: its lowest-scoring cut."""
    whole = lambda c: F.col(c).cast("decimal(20,0)")
    parts = counts.where("k > 0").select("lang", "phrase", "f")
    words = counts.where("k > 1").select("lang", "phrase", F.col("f").alias("a"), "k", F.split("phrase", " ").alias("w"))
    cuts = words.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("first"), F.array_join(F.slice("w", F.col("cut") + 1, F.col("k")), " ").alias("rest"))
    cuts = cuts.join(parts.withColumnsRenamed({"phrase": "first", "f": "l"}), ["lang", "first"]).join(parts.withColumnsRenamed({"phrase": "rest", "f": "r"}), ["lang", "rest"])
    cuts = cuts.withColumn("num", whole("a") * F.lit(2_000_000).cast("decimal(7,0)")).withColumn("den", whole("l") + whole("r"))
    low = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr("num div den").alias("score"), "cut", "l", "r")).alias("low"))
    return low.select("lang", "phrase", "a", "low.l", "low.r", "low.score")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, percent: int = INSIDE_PERCENT, shards: int = SHARDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each lang that no longer
    phrase holds ``percent`` of the time."""
    counts = frequent(docs, least, longest, shards)
    words = counts.where("k > 2").select("lang", "f", "k", F.split("phrase", " ").alias("w"))
    spans = [(m, s) for m in range(2, longest) for s in range(1, longest - m + 2)]
    inner = F.array(*[F.when(F.col("k") >= m + 1, F.when(F.col("k") >= s + m - 1, F.array_join(F.slice("w", s, m), " "))) for m, s in spans])
    longer = words.select("lang", "f", F.explode(inner).alias("phrase")).where("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    wide = lambda c, by: F.col(c).cast("decimal(20,0)") * F.lit(by).cast("decimal(5,0)")
    own = scored(counts).join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (wide("longer", 100) < wide("a", percent)))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = own.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    total = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    return first.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS phrase FROM w, range(1, 5) AS t(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
x AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
y AS (SELECT lang, phrase, k, a, ws, unnest(range(1, k)) AS cut FROM x),
z AS (SELECT lang, phrase, a, cut, array_to_string(ws[1 : cut], ' ') AS first, array_to_string(ws[cut + 1 : k], ' ') AS rest FROM y),
c AS (SELECT z.lang, z.phrase, a, cut, l.f AS l, r.f AS r, CAST((2000000::HUGEINT * a) // (l.f + r.f) AS BIGINT) AS score
  FROM z JOIN f l ON l.lang = z.lang AND l.phrase = z.first JOIN f r ON r.lang = z.lang AND r.phrase = z.rest),
s AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, array_to_string(ws[b : b + m - 1], ' ') AS phrase, max(a) AS longer FROM x, range(2, 4) AS t(m), range(1, 4) AS u(b) WHERE m < k AND b + m - 1 <= k GROUP BY ALL),
o AS (SELECT s.* FROM s LEFT JOIN i ON i.lang = s.lang AND i.phrase = s.phrase WHERE i.longer IS NULL OR 100 * i.longer < 80 * s.a)
SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o JOIN total USING (lang) QUALIFY rank <= 2000
"""
