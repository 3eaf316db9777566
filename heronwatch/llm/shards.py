"""Range sharding by sampled splitters, law ``bytes``: shards of near equal size.

Records are ordered by (hash of the text, doc_id), so equal texts are neighbours. A sample,
drawn with probability in proportion to a record's size, gives quantile boundaries for many
narrow ranges; ranges that turn out overfull get further boundaries from a sample of their
own. Exact sizes of the ranges and of the records within each then give every record its
place in the whole order, and the place gives shard and slot. Texts are never shuffled.

A group of equal texts no larger than a twentieth of a shard stays whole, so that no shard is
further than that (and one record) from its mean; a larger one is split between documents. Null
texts count as empty (size 1), very long ones have their own size; null ids come last; rows
that repeat in every way are alike and each gets a slot of its own; an empty table gives none;
other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

#: Share of a shard up to which a group of equal texts stays whole.
WHOLE_GROUP = 1 / 20
#: Samples drawn for each range; the driver holds this many times the ranges at most, about.
SAMPLES_PER_RANGE = 24
ROWS_PER_RANGE = 100_000
MOST_RANGES = 8_192
#: A range over this many times the mean gets splitters of its own.
OVERFULL = 2.0


def _ranges_of(rows: DataFrame, bounds: np.ndarray) -> DataFrame:
    """``range_id``: how many of the sorted (text_key, doc_key) boundaries lie at or below the row's key."""
    order = np.lexsort((bounds[:, 1], bounds[:, 0]))
    first, second = bounds[order, 0], bounds[order, 1]
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A compound key is found in two steps: the run of equal first parts, then within it.
        for batch in batches:
            a = batch.column(names.index("text_key")).to_numpy(zero_copy_only=False)
            b = batch.column(names.index("doc_key")).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(first, a, "left"), np.searchsorted(first, a, "right")
            at = low.copy()
            for i in np.flatnonzero(high > low):
                at[i] = low[i] + np.searchsorted(second[low[i] : high[i]], b[i], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], names=[*names, "range_id"])

    return rows.mapInArrow(run, rows.selectExpr("*", "0 as range_id").schema)


def _sample(rows: DataFrame, wanted: float, total: float, salt: int) -> np.ndarray:
    """Keys drawn with probability ``size * wanted / total``, by a hash, so reruns agree."""
    chance = F.col("size") * F.lit(wanted / total)
    drawn = F.pmod(F.xxhash64("doc_key", "text_key", F.lit(salt)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    got = rows.where(drawn < chance).select("text_key", "doc_key").toPandas()
    return got.to_numpy(dtype=np.int64).reshape(-1, 2)


def _quantiles(keys: np.ndarray, parts: int) -> np.ndarray:
    keys = keys[np.lexsort((keys[:, 1], keys[:, 0]))]
    at = (np.arange(1, parts) * len(keys)) // parts
    return np.unique(keys[at], axis=0) if len(keys) and parts > 1 else np.zeros((0, 2), np.int64)


def by_bytes(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc_key"),
        F.xxhash64(text).alias("text_key"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = materialize(rows)
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    if not count:
        empty = rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"))
        return empty.withColumns({"slot": F.lit(0).cast("long"), "grown_shard": F.lit(None).cast("int")})
    parts = int(min(MOST_RANGES, max(64, count // ROWS_PER_RANGE)))
    bounds = _quantiles(_sample(rows, parts * SAMPLES_PER_RANGE, total, 1), parts)
    ranged = _ranges_of(rows, bounds)
    sizes = ranged.groupBy("range_id").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).toPandas()
    over = sizes[(sizes["bytes"] > OVERFULL * total / parts) & (sizes["n"] > 1)]
    if len(over):
        own = ranged.where(F.col("range_id").isin([int(x) for x in over["range_id"]]))
        keys = _sample(own, parts * SAMPLES_PER_RANGE, float(over["bytes"].sum()), 2)
        extra = int(np.ceil(over["bytes"].sum() / (total / parts)))
        bounds = np.unique(np.concatenate([bounds, _quantiles(keys, extra)]), axis=0)
        ranged = _ranges_of(rows, bounds)
        sizes = ranged.groupBy("range_id").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).toPandas()
    sizes = sizes.sort_values("range_id")
    sizes["before"] = sizes["bytes"].cumsum() - sizes["bytes"]
    spark = docs.sparkSession
    starts = spark.createDataFrame(sizes[["range_id", "before"]].astype({"range_id": "int32", "before": "int64"}), "range_id int, before long")
    order = Window.partitionBy("range_id").orderBy("text_key", "doc_key")
    placed = (
        ranged.join(F.broadcast(starts), "range_id")  # as many rows as ranges
        .withColumn("place", F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    )
    target = total / shards
    # A small group takes the place of its first record: its range may end within the group.
    heads = materialize(
        placed.groupBy("text_key").agg(F.min("place").alias("group_place"), F.sum("size").alias("group_size"), F.count("*").alias("copies"))
        .where((F.col("copies") > 1) & (F.col("group_size") <= target * WHOLE_GROUP)).select("text_key", "group_place")
    )
    placed = materialize(
        placed.join(heads, "text_key", "left")
        .withColumn("shard", F.least(F.floor(F.coalesce("group_place", "place") * shards / total), F.lit(shards - 1)).cast("int"))
        .select("doc_id", "size", "text_crc32", "text_key", "doc_key", "range_id", "shard")
    )
    parts_of = placed.groupBy("shard", "range_id").agg(F.count("*").alias("n")).toPandas().sort_values(["shard", "range_id"])
    parts_of["first_slot"] = parts_of.groupby("shard")["n"].cumsum() - parts_of["n"]
    firsts = spark.createDataFrame(parts_of[["shard", "range_id", "first_slot"]].astype("int64"), "shard int, range_id int, first_slot long")
    within = Window.partitionBy("range_id", "shard").orderBy("text_key", "doc_key")
    return placed.join(F.broadcast(firsts), ["shard", "range_id"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first_slot") + F.row_number().over(within) - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
