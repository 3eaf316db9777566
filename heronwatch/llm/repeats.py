"""Passages that documents share: which units lie in a window that an earlier document has.

Units are words or bytes. The work has four steps, none of which compares pairs of documents:

1. *Anchors.* Positions are chosen so that any two equal windows hold an equal anchor (the
   caller says how). Each task packs its anchor hashes by bucket; a hash that several documents
   of the task share is sent once. Buckets tell which hashes stand in several documents.
2. *Runs.* Around those anchors, windows are grouped into runs that share their smallest
   inner gram. Of equal runs in a batch, only that of the smallest document is sent, once with
   all its places; the others recur for sure. A task sends the runs of a bucket of grams as one
   compressed row.
3. *Extension.* Runs meet by gram with their content. Equal contents are one; the caller finds
   the equal windows of those that differ, so every match is of the content itself.
4. The windows found become removed units of the document.

A gram that very many documents have would fill one task. A sample of the documents shows such
grams; their windows are sent one by one, dealt out by a hash of the whole window, so only equal
windows meet. Which grams these are changes how rows are dealt, never what is found.

Texts with fewer units than a window keep everything; null texts are empty, and a very long text
is cut into no pieces. A null doc_id counts as the largest; rows that repeat a doc_id are parts
of one document, so neither removes from the other. An empty table gives an empty result, and
columns other than doc_id and text may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import pieces, released
from .hashing import BYTE_VALUES, INVERSE, U, chunks, mix, opened, powers, prefix, ranges, slide, text_buffers, word_bounds, word_hashes
from .storage import materialize

LAST = (1 << 63) - 1
#: One of so many documents is looked at for hot grams: those that so many of them have, and so many grams at most.
SAMPLE_OF, HOT_IN_SAMPLE, MOST_HOT = 64, 30, 50_000
#: Runs that are compared at a time, about; a gram is never cut.
BLOCK_RUNS = 2_000
#: Bytes of text for each bucket of anchors.
BUCKET_BYTES = 2 << 20
#: Bytes of text for each bucket of runs: the runs of a bucket are unpacked in one place.
RUN_BUCKET_BYTES = 16 << 20
#: Bytes of text whose anchors a task packs at a time.
SLICE_BYTES = 12 << 20
GRAM_MASK = U((1 << 63) - 1)
CODEC = pa.Codec("zstd", compression_level=3)
#: Bits that tell the anchors of one document apart; a false hit costs a look-up, no more.
OWN_MASK = U((1 << 32) - 1)
#: Bits of an anchor hash within its bucket.
VALUE_BITS = 32


@dataclass(frozen=True)
class Shape:
    """How a text is cut and where its anchors lie."""

    words: bool
    window: int
    gram: int  # units of a gram; window - gram + 1 grams lie in a window
    anchors: Callable[[np.ndarray, np.ndarray, Shape], tuple[np.ndarray, np.ndarray]]
    grams_are_anchors: bool = False  # the anchors are the smallest grams of the windows

    @property
    def span(self) -> int:
        return self.window - self.gram + 1


def units(data: np.ndarray, offsets: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """(value of each unit, offsets of the rows in units)."""
    if not words:
        return BYTE_VALUES[data], offsets
    start, end, row = word_bounds(data, offsets)
    return word_hashes(data, start, end), np.searchsorted(row, np.arange(len(offsets)))


def grams(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` units at each position; shorter than ``values`` by k - 1."""
    if len(values) < k:
        return np.zeros(0, np.uint64)
    p = prefix(values)
    return mix((p[k:] - p[:-k]) * powers(INVERSE, len(values) - k + 1))


def smallest_grams(values: np.ndarray, offsets: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Anchors at the grams that are smallest in some window."""
    h = grams(values, shape.gram)
    at = np.flatnonzero(opened(h, shape.span))
    row = np.searchsorted(offsets, at, "right") - 1
    at = at[at + shape.gram <= offsets[row + 1]]
    return at, h[at]


def cover_positions(period: int, cover: tuple[int, ...]) -> Callable:
    """Anchors at the positions whose remainder by ``period`` is in a difference cover."""
    inside = np.isin(np.arange(period), cover)

    def anchors(values: np.ndarray, offsets: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
        h = grams(values, shape.gram)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(h)]
        at = np.arange(len(h))
        ok = inside[(at - offsets[row]) % period] & (at + shape.gram <= offsets[row + 1])
        return at[ok], h[ok]

    return anchors


def key_columns(docs: DataFrame) -> list[Column]:
    """key: doc_id, null as the largest; tag: tells rows of one doc_id apart, where there are
    any, and is odd for a null doc_id."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("key")
    repeated = bool(docs.select(key).groupBy("key").count().where("count > 1").take(1))
    tag = F.hash(F.coalesce(F.col("text").cast("string"), F.lit(""))).bitwiseAND(F.lit(-2)) if repeated else F.lit(0)
    return [key, F.when(F.col("doc_id").isNull(), tag.bitwiseOR(F.lit(1))).otherwise(tag).alias("tag")]


def doc_id() -> Column:
    return F.when(F.col("tag").bitwiseAND(F.lit(1)) == 0, F.col("key")).alias("doc_id")


def keyed(docs: DataFrame) -> DataFrame:
    """key, tag, text."""
    return docs.select(*key_columns(docs), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _planes(x: np.ndarray, kind: str = "<u8") -> bytes:
    """Small numbers byte by byte of their places, so that equal places compress away."""
    return x.astype(kind).view(np.uint8).reshape(-1, int(kind[-1])).T.tobytes()


def _from_planes(raw: bytes, kind: str = "<u8") -> np.ndarray:
    if not raw:
        return np.zeros(0, np.uint64)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(int(kind[-1]), -1).T).view(kind).ravel().astype(np.uint64)


def _pack(values: np.ndarray, keys: np.ndarray, bare: np.ndarray, buckets: int) -> tuple[bytes, bytes]:
    """Hashes of one bucket and their keys: first those sent without a key, then in the order of the keys."""
    order = np.lexsort((keys, ~bare))
    keys = keys[order][int(bare.sum()) :]
    return _planes(values[order] // U(buckets), "<u4"), _planes(np.diff(keys, prepend=0))


def _unpack(values: bytes, keys: bytes, bucket: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, keys and which of them came without a key; differences of keys wrap around."""
    v, k = _from_planes(values, "<u4") * U(buckets) + U(bucket), np.cumsum(_from_planes(keys).astype(np.int64))
    n = len(v) - len(k)
    return v, np.concatenate([np.zeros(n, np.int64), k]), np.arange(len(v)) < n


def shared_anchors(texts: DataFrame, shape: Shape, buckets: int) -> DataFrame:
    """(key, value): anchor hashes of a document that other documents have, too. ``buckets`` is a
    power of two; with it grow the bits by which hashes are told apart."""
    mask = U((buckets << VALUE_BITS) - 1)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1, SLICE_BYTES):
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = text_buffers(batch.column(1))
            found = []
            for a, b in chunks(offsets):
                values, own = units(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shape.words)
                at, h = shape.anchors(values, own, shape)
                row = np.searchsorted(own, at, "right") - 1 + a
                found.append(np.stack([h & mask, keys[row].view(np.uint64)]))
            if not found:
                continue
            v, k = np.concatenate(found, axis=1)
            k = k.view(np.int64)
            order = np.lexsort((k, v))
            v, k = v[order], k[order]
            new = np.ones(len(v), bool)
            new[1:] = (v[1:] != v[:-1]) | (k[1:] != k[:-1])
            v, k = v[new], k[new]
            same = v[1:] == v[:-1]
            many = np.zeros(len(v), bool)
            many[1:] |= same
            many[:-1] |= same
            # Shared within this batch: known already, so only the hash goes to its bucket.
            head = many.copy()
            head[1:] &= ~same
            send_v = np.concatenate([v[~many], v[head]])
            send_k = np.concatenate([k[~many], np.zeros(int(head.sum()), np.int64)])
            bare = np.arange(len(send_v)) >= len(send_v) - int(head.sum())
            bucket = (send_v % U(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            ids, starts = np.unique(bucket[order], return_index=True)
            ends = np.append(starts[1:], len(order))[: len(starts)]
            packed = [_pack(send_v[order[s:e]], send_k[order[s:e]], bare[order[s:e]], buckets) for s, e in zip(starts, ends, strict=True)]
            known_b, known = [], []
            if many.any():
                spread = (mix(k[many].view(np.uint64)) % U(buckets)).astype(np.int32)
                order = np.argsort(spread, kind="stable")
                known_b, starts = np.unique(spread[order], return_index=True)
                ends = np.append(starts[1:], len(order))[: len(starts)]
                known = [_pack(v[many][order[s:e]] & OWN_MASK, k[many][order[s:e]], np.zeros(e - s, bool), 1) for s, e in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([ids, known_b]).astype(np.int32)), pa.array(np.repeat([False, True], [len(packed), len(known)])),
                    pa.array([x[0] for x in packed + known], pa.binary()), pa.array([x[1] for x in packed + known], pa.binary()),
                ],
                names=["bucket", "known", "hashes", "keys"],
            )

    def meet(table: pa.Table) -> pa.Table:
        known = table.column("known").to_pylist()
        bucket = table.column("bucket")[0].as_py()
        parts = [_unpack(a, b, *((0, 1) if x else (bucket, buckets))) for a, b, x in zip(table.column("hashes").to_pylist(), table.column("keys").to_pylist(), known, strict=True)]
        done = [p for p, x in zip(parts, known, strict=True) if x]
        v = np.concatenate([np.zeros(0, np.uint64), *(p[0] for p, x in zip(parts, known, strict=True) if not x)])
        k = np.concatenate([np.zeros(0, np.int64), *(p[1] for p, x in zip(parts, known, strict=True) if not x)])
        bare = np.concatenate([np.zeros(0, bool), *(p[2] for p, x in zip(parts, known, strict=True) if not x)])
        order = np.argsort(v, kind="stable")
        v, k, bare = v[order], k[order], bare[order]
        same = v[1:] == v[:-1]
        many = np.zeros(len(v), bool)
        many[1:] |= same
        many[:-1] |= same
        many &= ~bare
        return pa.table(
            {
                "key": np.concatenate([k[many], *(p[1] for p in done)]),
                "value": (np.concatenate([v[many], *(p[0] for p in done)]) & OWN_MASK).astype(np.int64),
            }
        )

    sent = texts.select("key", "text").mapInArrow(local, "bucket int, known boolean, hashes binary, keys binary")
    return sent.groupBy("bucket").applyInArrow(meet, "key long, value long")


def _window_runs(values: np.ndarray, own: np.ndarray, at: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """(gram hash, first window, windows) of the runs of windows over the anchors ``at``.

    ``own`` are the rows' offsets; positions are those of the whole chunk.
    """
    h = grams(values, shape.gram)
    row = np.searchsorted(own, at, "right") - 1
    first = np.maximum(at - (shape.window - shape.gram), own[row])
    last = np.minimum(at, own[row + 1] - shape.window)
    ok = last >= first
    if not ok.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    diff = np.bincount(first[ok], minlength=len(values) + 1) - np.bincount(last[ok] + 1, minlength=len(values) + 1)
    p = np.flatnonzero(np.cumsum(diff) > 0)
    low = slide(h, shape.span, np.minimum)[p]
    low_at = np.flatnonzero(opened(h, shape.span))
    t = np.searchsorted(low_at, p)
    todo = np.flatnonzero(h[low_at[t]] != low)
    while len(todo):
        t[todo] += 1
        todo = todo[h[low_at[t[todo]]] != low[todo]]
    g = low_at[t]
    row = np.searchsorted(own, p, "right") - 1
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1] + 1) | (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    s = np.flatnonzero(new)
    return h[g[s]] & GRAM_MASK, p[s], np.diff(np.append(s, len(p)))


def _classes(*keys: np.ndarray) -> np.ndarray:
    """Class numbers of equal tuples, one number for each place."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def _merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of spans, those of one row that touch or overlap made one."""
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    # Rows are set apart, so that one running maximum serves all of them.
    far = (row - row[0]) * (int(end.max()) + 1) if len(row) else row
    reach = np.maximum.accumulate(end + far) if len(row) else end
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] + far[1:] > reach[:-1])
    s = np.flatnonzero(new)
    last = np.append(s[1:], len(row)) - 1
    return row[s], start[s], (reach - far)[last] if len(row) else end


def _lists(group: np.ndarray, values: np.ndarray, groups: int) -> pa.ListArray:
    """``values`` (rows of one or more integers, sorted by group) as one list for each group."""
    width = values.size // len(values) if len(values) else 1
    ends = np.searchsorted(group, np.arange(groups + 1)) * width
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.ravel().astype(np.int32)))


def _one_space(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of texts with one space between words and none around them."""
    texts = [(t or "").encode() for t in batch.column(column).to_pylist()]
    bare = [b" ".join(t.split()) for t in texts]
    return np.frombuffer(b"".join(bare), np.uint8), np.cumsum([0, *map(len, bare)])


def hot_grams(texts: DataFrame, shape: Shape) -> np.ndarray:
    """Grams that very many documents of a sample have, the most frequent first, sorted at last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 0):
            data, offsets = text_buffers(batch.column(0))
            for a, b in chunks(offsets):
                values, own = units(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shape.words)
                at, h = smallest_grams(values, own, shape)
                row = np.searchsorted(own, at, "right") - 1
                each = np.unique(np.stack([row.astype(np.uint64), h & GRAM_MASK]), axis=1)
                gram, n = np.unique(each[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n)], names=["gram", "n"])

    sample = texts.where(F.pmod(F.xxhash64("key", "tag"), F.lit(SAMPLE_OF)) == 0).select("text")
    often = sample.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_IN_SAMPLE)
    found = often.orderBy(F.desc("n"), "gram").limit(MOST_HOT).select("gram").toPandas()["gram"]
    return np.sort(found.to_numpy(np.int64).view(np.uint64))


def _packed_runs(part: np.ndarray, key: np.ndarray, tag: np.ndarray, n: np.ndarray, places: pa.ListArray, contents: list[bytes]) -> bytes:
    """The runs of one bucket; column by column they compress better than rows."""
    at = places.flatten().to_numpy()
    columns = [
        np.array([len(part), len(at)], "<u4").tobytes(), _planes(part, "<u4"), _planes(np.diff(key, prepend=0)), _planes(tag, "<i4"), _planes(n, "<u4"),
        _planes(places.value_lengths().to_numpy(), "<u4"), _planes(np.array([len(c) for c in contents]), "<u4"), _planes(at, "<u4"), *contents,
    ]
    raw = b"".join(columns)
    return np.array([len(raw)], "<u8").tobytes() + CODEC.compress(raw, asbytes=True)


def _unpacked_runs(packed: bytes) -> pa.RecordBatch:
    """(part, key, tag, n, at, content) of what ``_packed_runs`` gave."""
    raw = CODEC.decompress(packed[8:], int(np.frombuffer(packed, "<u8", 1)[0]), asbytes=True)
    rows, places = np.frombuffer(raw, "<u4", 2).tolist()
    first = 8

    def column(count: int, width: int) -> np.ndarray:
        nonlocal first
        first += count * width
        return _from_planes(raw[first - count * width : first], f"<u{width}").astype(np.int64)

    part, key, tag, n, times, sizes = (column(rows, w) for w in (4, 8, 4, 4, 4, 4))
    at = column(places, 4)
    offsets = lambda x: np.concatenate([[0], np.cumsum(x)]).astype(np.int32)
    content = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets(sizes)), pa.py_buffer(raw[first:])])
    return pa.RecordBatch.from_arrays(
        [pa.array(part), pa.array(np.cumsum(key)), pa.array(tag.astype(np.uint32).view(np.int32)), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets(times)), pa.array(at.astype(np.int32))), content],
        names=["part", "key", "tag", "n", "at", "content"],
    )


RUNS = "bucket int, packed binary, key long, tag int, at array<int>"


def runs(texts: DataFrame, shared: DataFrame, shape: Shape, buckets: int) -> DataFrame:
    """(bucket, packed, ...): runs of windows over the shared anchors of each document with the
    places where it has them, in one row for each bucket of a batch; runs that can meet have one
    ``part``, and so one bucket. ``buckets`` is a power of two.

    What recurs for sure is one row for each document of a batch: key, tag and the start and end
    of each span in ``at``, with nothing packed.
    """
    mask = U((buckets << VALUE_BITS) - 1)
    hot = hot_grams(texts, shape)
    lists = shared.groupBy("key").agg(F.collect_list("value").alias("values"))
    joined = texts.join(lists, "key").select("key", "tag", "text", "values")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2, SLICE_BYTES):
            keys, tags = batch.column(0), batch.column(1)
            data, offsets = _one_space(batch, 2) if shape.words else text_buffers(batch.column(2))
            raw = data.tobytes()
            lists_at = batch.column(3).offsets.to_numpy()
            wanted = batch.column(3).values.to_numpy(zero_copy_only=False).view(np.uint64)
            found, contents = [], []
            for a, b in chunks(offsets):
                part = data[offsets[a] : offsets[b]]
                if shape.words:
                    start, end, row = word_bounds(part, offsets[a : b + 1] - offsets[a])
                    values, own = word_hashes(part, start, end), np.searchsorted(row, np.arange(b - a + 1))
                else:
                    values, own = units(part, offsets[a : b + 1] - offsets[a], False)
                    start, end = np.arange(len(part)), np.arange(1, len(part) + 1)
                at, h = shape.anchors(values, own, shape)
                row = np.searchsorted(own, at, "right") - 1
                want = wanted[lists_at[a] : lists_at[b]]
                want_row = np.repeat(np.arange(b - a), np.diff(lists_at[a : b + 1]))
                tell = U(0x9E3779B97F4A7C15)
                known = lambda h, row: np.isin((h & OWN_MASK) + row.astype(np.uint64) * tell, want + want_row.astype(np.uint64) * tell)  # noqa: B023, E731
                g, lo, n = _window_runs(values, own, at[known(h, row)], shape)
                row = np.searchsorted(own, lo, "right") - 1
                if shape.grams_are_anchors:  # then a run whose gram is not shared cannot recur
                    hit = known(g, row)
                    g, lo, n, row = (x[hit] for x in (g, lo, n, row))
                part_of = g
                if len(hot) and (many := np.isin(g, hot)).any():
                    # One row for each window of a hot gram.
                    times = np.where(many, n, 1)
                    inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    g, row, many = (np.repeat(x, times) for x in (g, row, many))
                    lo, n = np.repeat(lo, times) + inner, np.where(many, 1, np.repeat(n, times))
                    part_of = np.where(many, mix(ranges(prefix(values), lo, lo + shape.window)) & GRAM_MASK, g)
                base = int(offsets[a])
                contents += [raw[base + x : base + y] for x, y in zip(start[lo].tolist(), end[lo + n + shape.window - 2].tolist(), strict=True)]
                found.append((part_of, row + a, lo - own[row], n))
            if not contents:
                continue
            part_of, row, lo, n = (np.concatenate(x) for x in zip(*found, strict=True))
            key = keys.to_numpy(zero_copy_only=False)[row]
            ids: dict[bytes, int] = {}
            cls = np.array([ids.setdefault(c, len(ids)) for c in contents])
            least = np.full(len(ids), LAST)
            np.minimum.at(least, cls, key)
            later = key > least[cls]
            # Runs of the smallest keys: one row for each run and document.
            own = np.flatnonzero(~later)
            own = own[np.lexsort((lo[own], row[own], cls[own]))]
            head = np.ones(len(own), bool)
            head[1:] = (cls[own][1:] != cls[own][:-1]) | (row[own][1:] != row[own][:-1])
            heads = own[head]
            places = _lists(np.cumsum(head) - 1, lo[own], len(heads))
            tag = tags.to_numpy(zero_copy_only=False)[row]
            value = part_of[heads] & mask
            bucket = (value % U(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            ids, starts = np.unique(bucket[order], return_index=True)
            ends = np.append(starts[1:], len(order))
            heads, value, places = heads[order], value[order] // U(buckets), places.take(pa.array(order))
            packed = []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                one = heads[s:e]
                packed.append(_packed_runs(value[s:e], key[one], tag[one], n[one], places[s:e], [contents[i] for i in one.tolist()]))
            none = lambda kind: pa.nulls(len(ids), kind)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(packed, pa.binary()), none(pa.int64()), none(pa.int32()), none(pa.list_(pa.int32()))],
                names=["bucket", "packed", "key", "tag", "at"],
            )
            if later.any():
                r, start, end = _merged(row[later], lo[later], lo[later] + n[later] - 1 + shape.window)
                docs, group = np.unique(r, return_inverse=True)
                spread = (mix(keys.to_numpy(zero_copy_only=False)[docs].view(np.uint64)) % U(buckets)).astype(np.int32)
                take = pa.array(docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(spread), pa.nulls(len(docs), pa.binary()), keys.take(take), tags.take(take), _lists(group, np.stack([start, end], axis=1), len(docs))],
                    names=["bucket", "packed", "key", "tag", "at"],
                )

    return joined.mapInArrow(run, RUNS)


SPANS = "key long, tag int, at array<int>"


def _found(rows: pa.Table, run: np.ndarray, offset: np.ndarray, window: int) -> pa.RecordBatch:
    """The windows at ``offset`` of the runs numbered ``run`` as spans at all places of those runs."""
    places = rows.column("at").combine_chunks()
    first, count = places.offsets.to_numpy(), np.diff(places.offsets.to_numpy())
    times = count[run]
    run, offset = np.repeat(run, times), np.repeat(offset, times)
    inner = np.arange(len(run)) - np.repeat(np.cumsum(times) - times, times)
    start = places.values.to_numpy()[first[run] + inner] + offset
    key, tag = rows.column("key").to_numpy(), rows.column("tag").to_numpy()
    doc = _classes(tag, key)
    d, s, e = _merged(doc[run], start, start + window)
    has, group = np.unique(d, return_inverse=True)
    one = np.zeros(int(doc.max()) + 1 if len(doc) else 0, np.int64)
    one[doc] = np.arange(len(doc))
    return pa.RecordBatch.from_arrays([pa.array(key[one[has]]), pa.array(tag[one[has]]), _lists(group, np.stack([s, e], axis=1), len(has))], names=["key", "tag", "at"])


def _starts(n: np.ndarray) -> np.ndarray:
    return np.cumsum(n) - n


def _block(t: pa.Table, shape: Shape, equal_windows: Callable) -> pa.RecordBatch:
    """Spans of the windows of whole groups that a smaller document has, too."""
    n, key, part = (t.column(c).to_numpy() for c in ("n", "key", "part"))
    ids: dict[bytes, int] = {}
    one = np.array([ids.setdefault(c, len(ids)) for c in t.column("content").to_pylist()])  # equal contents are one
    first = np.full(len(ids), -1)
    first[one[::-1]] = np.arange(len(one))[::-1]
    n_one, part_one = n[first], part[first]
    least_one = np.full(len(ids), LAST)
    np.minimum.at(least_one, one, key)
    # Only contents that share their part with others can have windows of others.
    _, back, times = np.unique(part_one, return_inverse=True, return_counts=True)
    several = np.flatnonzero(times[back] > 1)
    least = np.repeat(least_one, n_one)
    if len(several):
        contents = list(ids)
        cls = equal_windows([contents[i] for i in several.tolist()], n_one[several])
        at = np.repeat(_starts(n_one)[several] - _starts(n_one[several]), n_one[several]) + np.arange(int(n_one[several].sum()))
        low = np.full(int(cls.max()) + 1, LAST)
        np.minimum.at(low, cls, least[at])
        least[at] = low[cls]
    run = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(run)) - np.repeat(_starts(n), n)
    hit = key[run] > least[_starts(n_one)[one[run]] + offset]
    return _found(t, run[hit], offset[hit], shape.window)


def extended(every: DataFrame, shape: Shape, equal_windows: Callable) -> DataFrame:
    """Spans of the windows of ``runs`` that a smaller document has.

    ``equal_windows(contents, n)`` gives a class number for every window, run after run.
    """

    def met(packed: list[bytes]) -> Iterator[pa.RecordBatch]:
        """Of all runs of a bucket, a block of whole groups at a time."""
        t = pa.Table.from_batches([_unpacked_runs(x) for x in packed]).combine_chunks()
        order = np.argsort(t.column("part").to_numpy(), kind="stable")
        t = t.take(pa.array(order))
        part = t.column("part").to_numpy()
        first = 0
        while first < len(part):
            last = int(np.searchsorted(part, part[min(first + BLOCK_RUNS, len(part)) - 1], "right"))
            yield _block(t.slice(first, last - first), shape, equal_windows)
            first = last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        at = None
        for batch in batches:
            sure = pc.is_null(batch.column("packed"))
            if sure.true_count:
                yield batch.filter(sure).select(["key", "tag", "at"])
                batch = batch.filter(pc.invert(sure))
            for bucket, packed in zip(batch.column("bucket").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                if held and bucket != at:
                    yield from met(held)
                    held = []
                at = bucket
                held.append(packed)
        if held:
            yield from met(held)
        released()

    return every.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, SPANS)


def copies(texts: DataFrame) -> DataFrame:
    """(key, tag, size in bytes) of the rows whose whole text a smaller document has, by two
    hashes with different seeds and the size."""
    own = texts.select("key", "tag", F.xxhash64("text").alias("hash"), F.xxhash64(F.lit(1), "text").alias("second"), F.octet_length("text").alias("bytes"))
    same = ["hash", "second", "bytes"]
    # Written, so that the join has an exchange of its own and the rows of a large group can be split.
    least = materialize(own.groupBy(*same).agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most"))
    return own.join(least, same).where("key > least").select("key", "tag", "bytes").distinct()


def spans(texts: DataFrame, shape: Shape, equal_windows: Callable) -> DataFrame:
    """(key, tag, at): all units of each document that recur from a smaller one, ``at`` being
    the start and end of each span.

    Spans of one document may overlap, and that of a whole text may end beyond it. ``texts`` is
    what ``keyed`` returns. Copies of a text need no search: all of it recurs.
    """
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, run_buckets = (1 << max(8, (total // x).bit_length()) for x in (BUCKET_BYTES, RUN_BUCKET_BYTES))
    again = copies(texts)
    # Texts are dealt out by key once; the condition on tag is no equality, so that this stays
    # the one exchange of texts that all joins by key share.
    a = again.select(F.col("key").alias("a_key"), F.col("tag").alias("a_tag"))
    searched = texts.join(a, (F.col("key") == F.col("a_key")) & (F.col("tag") <= F.col("a_tag")) & (F.col("tag") >= F.col("a_tag")), "left_anti")
    every = runs(searched, shared_anchors(searched, shape, buckets), shape, run_buckets)
    return extended(every, shape, equal_windows).unionByName(again.select("key", "tag", F.array(F.lit(0), F.col("bytes")).alias("at")))


def marked(texts: DataFrame, shape: Shape, equal_windows: Callable) -> DataFrame:
    """``texts`` with ``spans``, an array of (tag, at), null where nothing was found; spans of
    another tag are those of another row with the doc_id."""
    found = spans(texts, shape, equal_windows).groupBy("key").agg(F.collect_list(F.struct("tag", "at")).alias("spans"))
    return texts.join(found, "key", "left").select("key", "tag", "text", "spans")


def removed(spans: pa.Array, tags: pa.Array, own: np.ndarray, window: int) -> np.ndarray:
    """Mask of the units that spans remove; ``own`` are the offsets of the rows in units."""
    each = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(spans)), each)
    inner = spans.flatten()
    places = inner.field("at")
    pairs = places.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) // 2
    row, tag = np.repeat(row, pairs), np.repeat(inner.field("tag").to_numpy(zero_copy_only=False), pairs)
    flat = places.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
    size = np.diff(own)
    ok = (tag == tags.to_numpy(zero_copy_only=False)[row]) & (size[row] >= window)
    row, flat = row[ok], flat[ok]
    start, end = own[row] + flat[:, 0], own[row] + np.minimum(flat[:, 1], size[row])
    gone = np.bincount(start, minlength=own[-1] + 1) - np.bincount(end, minlength=own[-1] + 1)
    return np.cumsum(gone)[: own[-1]] > 0
