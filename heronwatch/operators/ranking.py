"""Positions within groups, however few and large the groups are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import staged


def placed(rows: DataFrame, group: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """``rows`` with their position (from 1) within ``group`` by ``order``, which must leave no ties.

    Rows are range-partitioned by group and order, so a group may lie in many tasks; a row is
    placed among those of its task, after all rows of its group in earlier tasks. What is sent
    to every task has one row for each task and group in it: groups that fit in a task add one,
    and a group that does not adds one for each of its tasks.
    """
    ranged = staged(rows.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()))
    n = ranged.groupBy("_part", *group).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = n.select("_part", *group, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_part", *group).orderBy(*order)
    keys = ["_part", *group]
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    out = ranged.withColumn("_own", F.row_number().over(own)).alias("r").join(before.alias("b"), cond)
    return out.select(*[F.col(f"r.{c}") for c in rows.columns], (F.col("_before") + F.col("_own")).alias(name))
