"""N-gram Jaccard join: rare-first prefix filtering, exact.

A text's set holds its distinct word n-grams; equal sets are one node. All sets order their n-grams
alike, the rarest first: by the count of a table of hashed counters over the whole corpus, then by
hash. Two sets whose Jaccard is ``percent`` or more share an n-gram among the first
size - ceil(percent * size) + 1 of each, so those prefixes are exchanged and lists of the sets that
share one are compared. A pair is a candidate where it passes, at some shared n-gram,

* the length filter: the smaller size is ``percent`` of the larger at least;
* the positional filter: the n-grams left after the shared one, with it, still make the overlap;
* the suffix filter: parted by hash into cells, the sets differ in number by no more than the
  overlap allows (those before the shared n-gram count as different). A few cells go with every
  row of a list; ``CELLS`` of them are looked at once for each pair.

At the first n-gram that a pair shares all three hold if it is similar, so none is lost. Candidates
are confirmed once, on full sets. In a larger corpus more of the rare n-grams are shared by chance,
so a set leaves a list, unless that is long, where no other set of it passes the filters with it.

``join`` wants components, and a link inside a component adds nothing. So lists are first compared
with two of their sets, and then, block by block, all their sets that are still in different
components: every pair that could join two is confirmed, in lists of any size. ``links`` confirms all pairs instead.

Null, empty and blank texts have an empty set and no links; very long texts count whole. Rows
without doc_id are not compared (no component); rows that repeat a doc_id are one node; an empty
table gives an empty result. Columns other than doc_id and text play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import pieces, released
from .bits import Filter, kept
from .components import components
from .hashing import U, chunks, mix, text_buffers
from .shingles import confirmed, shingle_sets
from .storage import materialize

#: Counters of n-grams, by hash: a byte for each goes to every task.
COUNTER_BITS, CHUNK_BITS = 23, 16
#: Cells of the suffix filter, a byte each: all of a set's, and those (eight to a long) in a row of a list.
CELLS, FEW = 256, 16
#: Sets of a list that are compared with each other in one place.
BLOCK = 1_000
#: Lists of so many rows at most lose the sets that pass with no other.
SHORT = 128


def cells_of(row: np.ndarray, shingle: np.ndarray, rows: int) -> np.ndarray:
    """How many shingles of each of ``rows`` sets are in each cell."""
    return np.bincount(row * CELLS + ((shingle >> U(8)) & U(CELLS - 1)).astype(np.int64), minlength=rows * CELLS).reshape(-1, CELLS)


def packed_cells(cells: np.ndarray) -> list[pa.Array]:
    """Columns c1, c2 (few) and cells."""
    few = np.minimum(cells.reshape(len(cells), FEW, CELLS // FEW).sum(axis=2), 255).astype(np.uint8).view(np.int64)
    packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(CELLS), len(cells), [None, pa.py_buffer(np.minimum(cells, 255).astype(np.uint8).tobytes())])
    return [pa.array(few[:, 0]), pa.array(few[:, 1]), packed.cast(pa.binary())]


def _counted(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit hash of the set (s1, s2), its cells (few in c1 and c2); and,
    where chunk is not null, the counters of a task, in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << COUNTER_BITS, np.uint16)

        def rows(doc: pa.Array, n: np.ndarray, s1: np.ndarray, s2: np.ndarray, cells: np.ndarray, chunk: pa.Array, counters: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [doc, pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), *packed_cells(cells), chunk, counters],
                names=["doc_id", "n_shingles", "s1", "s2", "c1", "c2", "cells", "chunk", "counters"],
            )

        for batch in pieces(batches, 1):
            data, offsets = text_buffers(batch.column(1))
            for a, b in chunks(offsets):
                row, sh = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                count = np.bincount(row, minlength=b - a)
                at, times = np.unique(sh >> U(64 - COUNTER_BITS), return_counts=True)
                seen[at] = np.minimum(seen[at].astype(np.int64) + times, 65_535)
                filled = np.flatnonzero(count)
                s1, s2 = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
                if len(filled):
                    starts = np.concatenate([[0], np.cumsum(count)])[filled]
                    s1[filled] = mix(np.add.reduceat(sh, starts) + count[filled].astype(np.uint64))
                    s2[filled] = mix(np.add.reduceat(mix(sh ^ U(0xABCDEF)), starts))
                yield rows(batch.column(0)[a:b], count.astype(np.int64), s1, s2, cells_of(row, sh, b - a), pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.binary()))
        parts = seen.reshape(-1, 1 << CHUNK_BITS)
        full = np.flatnonzero(parts.any(axis=1))
        none = np.zeros(len(full), np.uint64)
        yield rows(pa.nulls(len(full), pa.int64()), none.view(np.int64), none, none, np.zeros((len(full), CELLS), np.int64), pa.array(full, pa.int32()), pa.array([zlib.compress(parts[c].tobytes(), 1) for c in full], pa.binary()))
        released()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, c1 long, c2 long, cells binary, chunk int, counters binary")


def _levels(counters: DataFrame) -> np.ndarray:
    """How frequent the n-grams of a counter are, in steps of an eighth of a doubling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(zlib.decompress(packed.as_py()), np.uint16)
                total[c] = own.astype(np.int64) if c not in total else total[c] + own
        steps = [np.minimum(255, 8 * np.log2(1 + t)).astype(np.uint8).tobytes() for t in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(steps, pa.binary())], names=["chunk", "steps"])
        released()

    out, width = np.zeros(1 << COUNTER_BITS, np.uint8), 1 << CHUNK_BITS
    for r in counters.repartition("chunk").mapInArrow(run, "chunk int, steps binary").collect():  # of a fixed size
        out[r.chunk * width : (r.chunk + 1) * width] = np.frombuffer(r.steps, np.uint8)
    return out


def _prefixes(docs: DataFrame, words: int, percent: int, levels: np.ndarray) -> DataFrame:
    """shingle, s1, s2, size, pos: the first n-grams of every set, rarest first. Equal sets of a
    batch come once."""
    sent = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = sent.value
        for batch in pieces(batches, 0):
            data, offsets = text_buffers(batch.column(0))
            for a, b in chunks(offsets):
                row, sh = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                if not len(row):
                    continue
                count = np.bincount(row, minlength=b - a)
                starts = np.concatenate([[0], np.cumsum(count)])
                filled = np.flatnonzero(count)
                s1 = mix(np.add.reduceat(sh, starts[filled]) + count[filled].astype(np.uint64))
                s2 = mix(np.add.reduceat(mix(sh ^ U(0xABCDEF)), starts[filled]))
                _, one = np.unique(s1, return_index=True)
                once = np.zeros(b - a, bool)
                once[filled[one]] = True
                # The order of all sets: by level, then by hash.
                order = np.lexsort((sh, level[sh >> U(64 - COUNTER_BITS)], row))
                sh = sh[order]
                pos = np.arange(len(sh)) - starts[row]
                size = count[row]
                head = (pos < size - (percent * size + 99) // 100 + 1) & once[row]
                set_at = np.searchsorted(filled, row[head])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sh[head].view(np.int64)), pa.array(s1[set_at].view(np.int64)), pa.array(s2[set_at].view(np.int64)), pa.array(size[head].astype(np.int32)), pa.array(pos[head].astype(np.int32))],
                    names=["shingle", "s1", "s2", "size", "pos"],
                )
        released()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "shingle long, s1 long, s2 long, size int, pos int")


def lists(docs: DataFrame, sets: DataFrame, words: int, percent: int, levels: np.ndarray) -> DataFrame:
    """shingle, node, size, pos, c1, c2: the sets that share an n-gram of their prefixes."""
    rows = materialize(_prefixes(docs.where("doc_id IS NOT NULL"), words, percent, levels))
    shared = materialize(rows.groupBy("shingle").agg(F.min("s1").alias("low"), F.max("s1").alias("high"), F.count("*").alias("n")).where("low <> high").select("shingle", "n"))
    # Most n-grams of most prefixes are in one set only: few rows are left to exchange.
    rows = kept(rows, "shingle", Filter.of(shared.select("shingle"))).hint("merge").join(shared, "shingle")
    met = rows.dropDuplicates(["shingle", "s1", "s2"]).join(sets, ["s1", "s2"]).select("shingle", "node", "size", "pos", "c1", "c2", "n")
    return materialize(partnered(met, percent))


def _pass_with(size: np.ndarray, pos: np.ndarray, few: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether the rows ``i`` and ``j`` of a list pass the three filters with each other."""
    both = size[i] + size[j]
    need = -(-percent * both // (100 + percent))
    ok = (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])) & (np.minimum(size[i] - pos[i], size[j] - pos[j]) >= need)
    at = np.flatnonzero(ok)
    ok[at] = np.abs(few[i[at]] - few[j[at]]).sum(axis=1) <= (both - 2 * need)[at]
    return ok


def partnered(rows: DataFrame, percent: int) -> DataFrame:
    """The rows of lists without those of short lists that pass the filters with no other set of it;
    ``n`` is the length of the list or more. The rows of a long list stay, dealt out one by one."""

    def partners(t: pa.Table) -> pa.Table:
        shingle, size, pos = (t.column(c).to_numpy().astype(np.int64) for c in ("shingle", "size", "pos"))
        few = np.stack([t.column(c).to_numpy() for c in ("c1", "c2")], axis=1).view(np.uint8).astype(np.int16)
        keep, at, k = np.zeros(len(shingle), bool), np.arange(len(shingle)), 1
        while len(at := at[at + k < len(shingle)]) and len(at := at[shingle[at] == shingle[at + k]]):
            found = at[_pass_with(size, pos, few, at, at + k, percent)]
            keep[found] = keep[found + k] = True
            k += 1
        return t.filter(pa.array(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            short = batch.column("n").to_numpy() <= SHORT
            yield batch.filter(pa.array(~short))
            now = pa.Table.from_batches([batch.filter(pa.array(short))])
            now = now if last is None else pa.concat_tables([last, now])
            if not now.num_rows:
                continue
            shingle = now.column("shingle").to_numpy()
            whole = int(np.searchsorted(shingle, shingle[-1], "left"))
            if whole:
                yield from partners(now.slice(0, whole)).to_batches()
            last = now.slice(whole)
        if last is not None and last.num_rows:
            yield from partners(last).to_batches()
        released()

    dealt = rows.repartition("shingle", F.when(F.col("n") > SHORT, F.xxhash64("node")))
    return dealt.sortWithinPartitions("shingle").mapInArrow(run, rows.schema).drop("n")


def _passes(x: str, y: str, percent: int) -> Column:
    """The three filters, for the rows with columns of prefix ``x`` and ``y``."""
    size, other, pos, at = (F.col(f"{p}{c}") for c in ("size", "pos") for p in (x, y))
    need = F.ceil(F.lit(percent) * (size + other) / F.lit(100 + percent))
    left, right = size - pos, other - at
    byte = lambda p, c, k: F.shiftright(F.col(f"{p}{c}"), 8 * k).bitwiseAND(F.lit(255))
    apart = sum((F.abs(byte(x, c, k) - byte(y, c, k)) for c in ("c1", "c2") for k in range(8)), F.lit(0))
    return (100 * F.least(size, other) >= percent * F.greatest(size, other)) & (F.least(left, right) >= need) & (apart <= size + other - 2 * need)


def starred(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): the sets of a list with two of them, the first and the last in an order by hash."""
    kept = ["node", "size", "pos", "c1", "c2"]
    key = F.struct(F.xxhash64("node").alias("order"), "component", *kept)
    ends = rows.groupBy("shingle").agg(F.min(key).alias("low"), F.max(key).alias("high")).where("low.node <> high.node")
    ends = ends.select("shingle", F.explode(F.array("low", "high")).alias("h")).select("shingle", F.col("h.component").alias("hcomponent"), *[F.col(f"h.{c}").alias(f"h{c}") for c in kept])
    # Written, so that the join has an exchange of its own and long lists can be split.
    met = rows.hint("merge").join(materialize(ends), "shingle").where((F.col("component") != F.col("hcomponent")) & _passes("", "h", percent))
    return met.select(F.least("node", "hnode").alias("a"), F.greatest("node", "hnode").alias("b")).distinct()


def _apart(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """By how many n-grams sets differ at least: the differences of their cells added up."""
    out = np.zeros(len(i), np.int64)
    for a in range(0, len(i), 4096):
        b = slice(a, a + 4096)
        out[b] = np.abs(x[i[b]].astype(np.int16) - y[j[b]]).sum(axis=1)
    return out


def _near(key: np.ndarray, block: np.ndarray, columns: dict[str, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one key, in different components (and blocks, where the key has two), that
    pass the filters; rows of a key are next to each other."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    component, size, pos, cells = (columns[c] for c in ("component", "size", "pos", "cells"))
    rows, k = np.arange(len(key)), 1
    while len(rows := rows[rows + k < len(key)]) and len(rows := rows[(key[rows] == key[rows + k]).all(axis=1)]):
        i, j = rows, rows + k
        two = key[i, 1] != key[i, 2]
        ok = (component[i] != component[j]) & (~two | (block[i] != block[j])) & (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j]))
        i, j = i[ok], j[ok]
        need = -(-percent * (size[i] + size[j]) // (100 + percent))
        ok = np.minimum(size[i] - pos[i], size[j] - pos[j]) >= need
        i, j, most = i[ok], j[ok], (size[i] + size[j] - 2 * need)[ok]
        ok = _apart(cells, i, cells, j) <= most
        found.append((i[ok], j[ok]))
        k += 1
    if not found:
        return rows[:0], rows[:0]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _unpacked(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, CELLS)


def fitting(pairs: DataFrame, cells: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` that pass the suffix filter on all cells."""
    side = lambda c: cells.select(F.col("node").alias(c), F.col("cells").alias(f"cells_{c}"), F.col("size").alias(f"size_{c}"))
    both = pairs.hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b").select("a", "b", "size_a", "size_b", "cells_a", "cells_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = sum(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
            every = np.arange(batch.num_rows)
            apart = _apart(_unpacked(batch.column(4)), every, _unpacked(batch.column(5)), every)
            yield batch.select([0, 1]).filter(pa.array(apart <= size - 2 * -(-percent * size // (100 + percent))))
        released()

    return both.mapInArrow(run, "a long, b long")


def _nearest(component: np.ndarray, cells: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j) the one of each component whose cells differ least."""
    own = np.concatenate([component[i], component[j]])
    order = np.lexsort((np.tile(_apart(cells, i, cells, j), 2), own))
    head = np.ones(len(own), bool)
    head[1:] = own[order][1:] != own[order][:-1]
    at = np.unique(order[head] % max(len(i), 1))
    return i[at], j[at]


def blocked(rows: DataFrame, cells: DataFrame, percent: int, nearest: bool = False) -> DataFrame:
    """(a, b): all pairs of a list in different components that pass the filters, or of those the
    nearest one of each component. A long list is cut into blocks, and every two of them meet in
    one place. ``cells`` has those of each node."""
    several = materialize(rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("shingle", "n"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = rows.hint("merge").join(several, "shingle").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    meets = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = dealt.hint("merge").join(cells, "node").select("shingle", "node", "component", "size", "pos", "cells", "block", meets)
    key = ["shingle", "i", "j"]
    dealt = dealt.select("shingle", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "component", "size", "pos", "block", "cells")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(t: pa.Table) -> pa.RecordBatch:
            own = {c: t.column(c).to_numpy().astype(np.int64) for c in t.column_names if c != "cells"}
            keys = np.stack([own[c] for c in key], axis=1)
            own["cells"] = _unpacked(t.column("cells"))
            i, j = _near(keys, own["block"], own, percent)
            if nearest:
                i, j = _nearest(own["component"], own["cells"], i, j)
            x, y = own["node"][i], own["node"][j]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

        last = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if last is None else pa.concat_tables([last, now])
            if not now.num_rows:
                continue
            keys = np.stack([now.column(c).to_numpy().astype(np.int64) for c in key], axis=1)
            ends = np.flatnonzero((keys != keys[-1]).any(axis=1))
            whole = int(ends[-1]) + 1 if len(ends) else 0
            if whole:
                yield pairs(now.slice(0, whole))
            last = now.slice(whole)
        if last is not None and last.num_rows:
            yield pairs(last)
        released()

    return dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long").distinct()


class _Sets:
    """What the steps of a join share: sets of the documents, lists of prefixes, texts to confirm on."""

    def __init__(self, docs: DataFrame, words: int, percent: int):
        if not 0 < percent <= 100 or words < 1:
            raise ValueError("percent must be 1 to 100, words 1 or more")
        self.words, self.percent = words, percent
        counted = materialize(_counted(docs, words))
        self.rows = counted.where("chunk IS NULL")
        filled = self.rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
        same = [F.min(c).alias(c) for c in ("c1", "c2")]
        self.sets = materialize(filled.groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), *same))
        levels = _levels(counted.where("chunk IS NOT NULL").select("chunk", "counters"))
        self.lists = lists(docs, self.sets, words, percent, levels)
        ends = materialize(self.lists.select("node").distinct())
        known = Filter.of(ends)
        own = filled.join(self.sets.select("node", "s1", "s2"), ["s1", "s2"]).where("doc_id = node").select("node", F.col("n_shingles").alias("size"), "cells")
        self.cells = materialize(kept(own, "node", known).dropDuplicates(["node"]))
        self.texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The linked ones of ``pairs`` (written). Only texts of sets that are in a pair are exchanged."""
        ends = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
        texts = kept(self.texts, "doc_id", Filter.of(ends)).join(ends.hint("merge"), "doc_id", "left_semi")
        return materialize(confirmed(pairs, materialize(texts), self.words, self.percent))

    def of(self, parts: DataFrame | None) -> DataFrame:
        """The lists with the component of each set."""
        if parts is None:
            return self.lists.withColumn("component", F.col("node"))
        return self.lists.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))

    def of_documents(self) -> DataFrame:
        """doc_id, node of every document with a set. Both sides are written, so that the rows of a
        set that very many documents have can be split."""
        return self.rows.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "s1", "s2").hint("merge").join(self.sets.select("s1", "s2", "node"), ["s1", "s2"]).select("doc_id", "node")

    @staticmethod
    def repeated(documents: DataFrame) -> DataFrame:
        """(a, b): sets of one doc_id that rows with different texts share."""
        several = documents.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("doc_id", "a")
        return documents.join(several, "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct()


def links(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(a, b): all linked pairs of different sets, by the smallest doc_id of each, a < b."""
    own = _Sets(docs, words, percent)
    return own.confirmed(blocked(own.of(None), own.cells.select("node", "cells"), percent))


def join(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    own = _Sets(docs, words, percent)
    documents = materialize(own.of_documents())
    first = materialize(fitting(starred(own.of(None), percent), own.cells, percent))
    parts = materialize(components(own.confirmed(first)))
    rest = materialize(blocked(materialize(own.of(parts)), own.cells.select("node", "cells"), percent).join(first, ["a", "b"], "left_anti"))
    # Components stand for the links that made them.
    linked = parts.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    parts = materialize(components(linked.unionByName(own.confirmed(rest)).unionByName(own.repeated(documents))))
    documents = documents.hint("merge").join(parts, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "node")).alias("component"))
    # A repeated doc_id with other texts has one component, the smallest of its sets and their links.
    out = own.rows.select("doc_id", "n_shingles").join(documents, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def sql(words: int, percent: int) -> str:
    """doc_id, n_shingles, component_id by all pairs that share a shingle: for small tables."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= {words} THEN list_transform(range(1, len(ws) - {words} + 2), lambda i: array_to_string(ws[i : i + {words - 1}], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, doc_id) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) USING (doc_id)"""
