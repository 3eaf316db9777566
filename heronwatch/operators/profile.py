"""Exact figures of columns: nulls, extremes, distinct values, quantiles. No group is held in one task.

Values are counted by (group, column, value) first, which the map side combines, so a group's
distinct values are rows of a table. A quantile is then a selection by counts: the counted values
are range-partitioned, each task's total of each group says in which task a rank lies, and only
the rows of those tasks are added up one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import staged


def value_counts(rows: DataFrame, columns: list[str], by: list[str] = (), kind: str = "double") -> DataFrame:
    """by, column, value, n: how often each value of each column is there, nulls included."""
    value = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value")) for c in columns])).alias("x")
    return rows.select(*by, value).select(*by, "x.column", "x.value").groupBy(*by, "column", "value").agg(F.count("*").alias("n"))


def _same(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"v.{k}").eqNullSafe(F.col(f"r.{k}"))
    return out


def quantiles(counts: DataFrame, at: list[float], by: list[str] = ()) -> DataFrame:
    """by, column, q, quantile: the exact quantiles of ``value_counts``, between two values in
    proportion (nulls are left out; columns without values have no row).

    Rows that are added up one by one are those of one or two tasks for each rank.
    """
    keys = [*by, "column"]
    values = counts.where("value IS NOT NULL")
    ranged = staged(values.repartitionByRange(*keys, "value").withColumn("_part", F.spark_partition_id()))
    totals = staged(ranged.groupBy("_part", *keys).agg(F.sum("n").alias("m")))  # a row for each task and group in it
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.withColumn("before", F.coalesce(F.sum("m").over(earlier), F.lit(0)))
    place = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), ((F.col("all") - 1) * F.lit(q)).alias("place")) for q in at])).alias("x")
    wanted = totals.groupBy(*keys).agg(F.sum("m").alias("all")).select(*keys, place).select(*keys, "x.q", "x.place")
    wanted = wanted.select(*keys, "q", (F.col("place") - F.floor("place")).alias("share"), F.explode(F.array(F.floor("place"), F.ceil("place"))).alias("rank")).distinct()
    # The task in which a rank (from 0) lies.
    where = staged(parts.alias("v").join(wanted.alias("r"), _same(keys) & (F.col("r.rank") >= F.col("v.before")) & (F.col("r.rank") < F.col("v.before") + F.col("v.m"))).select("v._part", *[f"v.{k}" for k in keys], "v.before", "r.q", "r.share", "r.rank"))
    own = ranged.alias("v").join(where.select("_part", *keys, "before").distinct().alias("r"), _same(["_part", *keys])).select("v.*", "r.before")
    upto = Window.partitionBy("_part", *keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("end", F.col("before") + F.sum("n").over(upto))
    hit = own.alias("v").join(where.alias("r"), _same(["_part", *keys]) & (F.col("r.rank") < F.col("v.end")) & (F.col("r.rank") >= F.col("v.end") - F.col("v.n")))
    pair = hit.groupBy(*[F.col(f"v.{k}").alias(k) for k in keys], F.col("r.q").alias("q")).agg(F.min("v.value").alias("low"), F.max("v.value").alias("high"), F.max("r.share").alias("share"))
    between = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * F.col("share"))
    return pair.select(*keys, "q", between.alias("quantile"))


def column_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Per numeric column: share of nulls, least, median, most and distinct values, all exact."""
    counts = staged(value_counts(rows, columns))
    known = F.col("value").isNotNull()
    out = counts.groupBy("column").agg(
        (F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)) / F.sum("n")).alias("nulls"), F.min("value").alias("least"), F.max("value").alias("most"), F.count("value").alias("distinct")
    )
    middle = quantiles(counts, [0.5]).select("column", F.round("quantile", 6).alias("median"))
    return out.join(middle, "column", "left").select("column", F.round(100 * F.col("nulls"), 4).alias("null_pct"), "least", "median", "most", "distinct")


def top_values(rows: DataFrame, columns: list[str], k: int = 3) -> DataFrame:
    """The ``k`` most frequent values of each column, with their share of all rows."""
    counts = staged(value_counts(rows, columns, kind="string"))
    total = counts.groupBy("column").agg(F.sum("n").alias("all"))
    best = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    first = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return first.join(F.broadcast(total), "column").select("column", "value", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"), "rank")  # a row for each column
