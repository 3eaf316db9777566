"""Near-duplicates by an LSH forest of MinHash labels.

A text's set holds its distinct word shingles. Every distinct set gets ``TREES`` labels of
``DEPTH`` minimum hashes. Each tree is one sorted order of all labels, ties in an order of the
tree's own: a set's candidates are its nearest rows in that order, as long as they share a prefix
of ``LEAST_DEPTH`` hashes. Depth adapts to the region: where few labels share a prefix, short
prefixes count; where many do, the nearest rows are those that share the longest. Candidates are
confirmed on full sets: first the best one of each set, then those that would join two components.

A region where more labels share the least prefix than a row has neighbours is crowded. There the
join goes by whole sets, and is exact: similar sets share one of their rarest shingles, so every
crowded set stands in the list of each of them (``crowd_sets``), and lists are compared as in
``jaccard``: first with two of their sets, together with the best candidates, then all pairs that
are still in different components, block by block, in lists of any size.

Equal sets are one node, so copies make no pairs. Null, empty and blank texts have an empty
set and no links; very long texts count whole. Rows without doc_id are not compared; rows that
repeat a doc_id are one node; an empty table gives an empty result. Column names of the input
other than doc_id and text play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import pieces, released
from .components import components
from .hashing import U, chunks, mix, text_buffers
from .jaccard import blocked, cells_of, fitting, packed_cells, starred
from .shingles import confirmed, shingle_sets
from .storage import materialize, shielded, unshielded

TREES, DEPTH, LEAST_DEPTH = 16, 8, 4
#: Rows after a row, in each order, that become its candidates; regions of more are crowded.
NEAREST = 6
#: Marks in column b: a row at the edge of a partition, a row of a crowded region.
EDGE, CROWD = -1, -2
_rng = np.random.default_rng(77)
_FACTORS = _rng.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * U(2) + U(1)


def features(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit hash of the set (s1, s2) and its labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            data, offsets = text_buffers(batch.column(1))
            for a, b in chunks(offsets):
                own = offsets[a : b + 1] - offsets[a]
                row, sh = shingle_sets(data[offsets[a] : offsets[b]], own, words)
                count = np.bincount(row, minlength=b - a)
                filled = np.flatnonzero(count)
                starts = np.concatenate([[0], np.cumsum(count)])[filled]
                s1, s2 = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
                labels = np.zeros((b - a, TREES * DEPTH), ">u4")
                if len(filled):
                    s1[filled] = mix(np.add.reduceat(sh, starts) + count[filled].astype(np.uint64))
                    s2[filled] = mix(np.add.reduceat(mix(sh ^ U(0xABCDEF)), starts))
                    for k in range(TREES * DEPTH):
                        labels[filled, k] = np.minimum.reduceat((sh * _FACTORS[k]) >> U(32), starts)
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * TREES * DEPTH), b - a, [None, pa.py_buffer(labels.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(count.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), packed.cast(pa.binary())],
                    names=["doc_id", "n_shingles", "s1", "s2", "labels"],
                )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, labels binary")


def _neighbours(tree: np.ndarray, labels: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, shared prefix) of rows up to NEAREST apart in one sorted order, a < b."""
    out = [], [], []
    for k in range(1, min(NEAREST, len(tree) - 1) + 1):
        same = (labels[k:] == labels[:-k]).cumprod(axis=1).sum(axis=1)
        ok = (tree[k:] == tree[:-k]) & (same >= LEAST_DEPTH) & (node[k:] != node[:-k])
        x, y = node[:-k][ok], node[k:][ok]
        out[0].append(np.minimum(x, y))
        out[1].append(np.maximum(x, y))
        out[2].append(same[ok])
    return tuple(np.concatenate(o) if o else np.zeros(0, np.int64) for o in out)


def _crowded(tree: np.ndarray, labels: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Nodes of rows that share the least prefix with a row beyond their neighbours."""
    k = NEAREST + 1
    far = (tree[k:] == tree[:-k]) & (labels[k:, :LEAST_DEPTH] == labels[:-k, :LEAST_DEPTH]).all(axis=1)
    return np.unique(np.concatenate([node[k:][far], node[:-k][far]]))


def candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, support): pairs of nodes that are neighbours in some order, with the prefix
    lengths they share added up; and the nodes of crowded regions. ``nodes`` has node and labels."""
    width, reach = 4 * DEPTH, NEAREST + 1
    trees = nodes.select("node", F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.substring("labels", t * width + 1, width).alias("label")) for t in range(TREES)])).alias("x"))
    trees = trees.select("x.tree", "x.label", F.xxhash64("x.tree", "node").alias("tie"), "node")
    order = ["tree", "label", "tie", "node"]
    ordered = trees.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")

    def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        labels = np.frombuffer(b"".join(batch.column("label").to_pylist()), ">u4").reshape(-1, DEPTH)
        return batch.column("tree").to_numpy(zero_copy_only=False), labels, batch.column("node").to_numpy(zero_copy_only=False)

    def rows(a: np.ndarray, b: np.ndarray, shared: np.ndarray, label: list[bytes] | None = None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(shared.astype(np.int32)), pa.array(label, pa.binary()) if label else pa.nulls(len(a), pa.binary())],
            names=["a", "b", "shared", "edge"],
        )

    def edge(tree: np.ndarray, labels: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        return rows(node, np.full(len(node), EDGE), tree, [x.tobytes() for x in labels])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = arrays(batch)
            if last is None:
                yield edge(*(x[:reach] for x in now))
                last = tuple(x[:0] for x in now)
            joined = tuple(np.concatenate([x, y]) for x, y in zip(last, now, strict=True))
            yield rows(*_neighbours(*joined))  # pairs within the carried rows come again; they are merged below
            crowd = _crowded(*joined)
            yield rows(crowd, np.full(len(crowd), CROWD), np.zeros(len(crowd)))
            last = tuple(x[-reach:] for x in joined)
        if last is not None:
            yield edge(*last)
        released()

    found = materialize(ordered.mapInArrow(run, "a long, b long, shared int, edge binary"))
    # Rows at the edges of partitions meet here: a few for each partition.
    edges = found.where(F.col("b") == EDGE).select(F.col("shared").alias("tree"), F.col("edge").alias("label"), F.xxhash64("shared", "a").alias("tie"), F.col("a").alias("node")).distinct()
    w = Window.partitionBy("tree").orderBy("label", "tie", "node")
    seams = edges.select("label", "node", *[F.lead(F.struct("label", "node"), k).over(w).alias(f"n{k}") for k in range(1, reach + 1)])
    seams = seams.select("label", "node", F.posexplode(F.array(*[f"n{k}" for k in range(1, reach + 1)])).alias("k", "x")).where("x IS NOT NULL")
    seams = materialize(seams.where(F.substring("label", 1, 4 * LEAST_DEPTH) == F.substring("x.label", 1, 4 * LEAST_DEPTH)).select("k", "node", F.col("x.node").alias("other")))
    near = seams.where((F.col("k") < NEAREST) & (F.col("node") != F.col("other"))).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), F.lit(LEAST_DEPTH).alias("shared"))
    pairs = found.where("b >= 0").select("a", "b", "shared").unionByName(near).groupBy("a", "b").agg(F.sum("shared").alias("support"))
    crowd = found.where(F.col("b") == CROWD).select(F.col("a").alias("node")).unionByName(seams.where(F.col("k") == NEAREST).select(F.explode(F.array("node", "other")).alias("node"))).distinct()
    return pairs, crowd


def crowd_sets(crowd: DataFrame, texts: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(shingle, node, size, pos, c1, c2): the rarest shingles of each set of ``crowd`` (node), those
    that several of its sets have, with their places in the order; and (node, size, cells) of each set.

    Shingles have one order for all sets, the rarest first. Similar sets share percent of the
    larger one at least, so they share one of the first size - percent * size + 1 of each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1, 1 << 20):
            row, sh = shingle_sets(*text_buffers(batch.column(1)), words)
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            each = pa.ListArray.from_arrays(pa.array(ends), pa.array(sh.view(np.int64)))
            cells = packed_cells(cells_of(row, sh, batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends)), *cells, each], names=["node", "size", "c1", "c2", "cells", "each"])

    own = crowd.join(texts.select(F.col("doc_id").alias("node"), "text"), "node").select("node", "text")
    own = materialize(own.mapInArrow(run, "node long, size int, c1 long, c2 long, cells binary, each array<long>"))
    # Rows that repeat a doc_id with other texts are one node with several sets.
    own = own.withColumn("set", F.xxhash64("each")).dropDuplicates(["node", "set"])
    rows = own.select("node", "set", "size", F.explode("each").alias("shingle"))
    often = rows.groupBy("shingle").agg(F.count("*").alias("n"))
    sets = rows.join(often, "shingle").groupBy("node", "set", "size").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("all"))
    first = (F.col("size") - F.ceil(F.lit(percent) * F.col("size") / 100) + 1).cast("int")
    sets = sets.select("node", "set", F.posexplode(F.slice("all", 1, first)).alias("pos", "x")).where("x.n > 1")
    return sets.join(own.select("node", "set", "size", "c1", "c2"), ["node", "set"]).select("x.shingle", "node", "size", "pos", "c1", "c2"), own.select("node", "size", "cells")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    rows = materialize(features(docs, words))
    filled = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    sets = filled.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "labels")).alias("x")).select("s1", "s2", F.col("x.doc_id").alias("node"), "x.labels")
    pairs, crowd = candidates(sets.select("node", "labels"))
    pairs, crowd = materialize(pairs), materialize(crowd)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(crowd.select(F.col("node").alias("doc_id"))).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = materialize(texts.join(ends.hint("merge"), "doc_id", "left_semi"))  # ends grow with the corpus: no broadcast
    each = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y"), "support"), F.struct(F.col("b").alias("x"), F.col("a").alias("y"), "support"))).alias("e")).select("e.*")
    best = each.groupBy("x").agg(F.max(F.struct("support", (-F.col("y")).alias("y"))).alias("m")).select("x", (-F.col("m.y")).alias("y"))
    first = best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    crowded = bool(crowd.take(1))
    if crowded:
        lists, cells = crowd_sets(crowd, texts, words, percent)
        lists = materialize(lists)
        first = first.unionByName(fitting(starred(lists.withColumn("component", F.col("node")), percent), cells, percent))
    first = materialize(first.distinct())
    links = materialize(confirmed(first, texts, words, percent))
    parts = materialize(components(links))
    if crowded:  # the nearest set of each component first: most of a large group is then one, and needs no more links
        own = cells.select("node", "cells")
        placed = lambda parts: materialize(lists.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")))
        near = materialize(blocked(placed(parts), own, percent, nearest=True).join(first, ["a", "b"], "left_anti"))
        first = first.unionByName(near)
        parts = materialize(components(links.unionByName(confirmed(near, texts, words, percent))))
    of = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    rest = pairs.select("a", "b")
    if crowded:  # the lists have all pairs of two crowded sets
        inside = lambda c: crowd.select(F.col("node").alias(c), F.lit(True).alias(f"in{c}"))
        rest = rest.join(inside("a"), "a", "left").join(inside("b"), "b", "left").where("ina IS NULL OR inb IS NULL").select("a", "b")
    rest = rest.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    if crowded:
        rest = rest.unionByName(blocked(placed(parts), own, percent))
    more = confirmed(materialize(rest.join(first, ["a", "b"], "left_anti")), texts, words, percent)
    # Components stand for the links that made them.
    links = materialize(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    # Copies of a set hang on its smallest document; a repeated doc_id joins the sets of its rows.
    same = filled.join(sets.select("s1", "s2", "node"), ["s1", "s2"]).where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    final = components(links.unionByName(same.distinct()))
    out = rows.select("doc_id", "n_shingles").join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group, all without doc_id; same columns."""
    gone = near_duplicates(docs, words, percent).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    own = shielded(docs, F.col("doc_id").cast("long").alias("id"))
    return unshielded(own.join(gone, F.col("id") == F.col("_gone"), "left_anti"), docs)
