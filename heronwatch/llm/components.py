"""Connected components of a graph given as links, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import released
from .storage import materialize

#: Links that one task contracts at a time before it hands on their spanning stars.
LOCAL_LINKS = 500_000


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) over the given links; roots are left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _contract(links: DataFrame) -> DataFrame:
    """The links of each task replaced by stars with the same components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, n = [], [], 0

        def stars() -> pa.RecordBatch:
            u, v = _stars(np.concatenate(a), np.concatenate(b))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            a.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            b.append(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64))
            n += batch.num_rows
            if n >= LOCAL_LINKS:
                yield stars()
                a, b, n = [], [], 0
        if n:
            yield stars()
        released()

    return links.mapInArrow(run, "u long, v long")


def _done(edges: DataFrame) -> bool:
    """Whether ``edges`` are stars: every u has one v, and no v is a u."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    roles = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return not roles.where("up > 1 OR (up > 0 AND least = 0)").agg(F.count("*")).first()[0]


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (two long columns): the smallest reachable
    node, itself included. Rounds grow with the logarithm of the longest path."""
    a, b = links.columns[:2]
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    # What was written comes back in fewer tasks, whose stars meet once more.
    edges = materialize(_contract(materialize(_contract(edges))))
    while not _done(edges):
        # Every larger neighbour of a node moves to the node's smallest neighbour ...
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that the join below has an exchange of its own: the rows of a node with very many neighbours can be split.
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # ... and the smaller neighbours of a node, with itself, to the smallest of them.
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = materialize(small.where("u <> v").distinct())
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(roots)
