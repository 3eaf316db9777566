"""Ranks and running sums over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize


def ranked(df: DataFrame, order: list[str], sums: dict[str, str] | None = None) -> DataFrame:
    """``df`` with ``rank`` (from 0, by ``order``) and, for each name in ``sums``, the total of
    that integer column over all earlier rows.

    Rows are range-partitioned by ``order``; the driver sees one total for each partition.
    Order nulls must not matter to the caller: they come first. Ties are ranked in any order.
    """
    sums = sums or {}
    ranged = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = [F.count("*").alias("rank"), *(F.sum(c).alias(n) for n, c in sums.items())]
    per = sorted(ranged.groupBy("_part").agg(*totals).collect(), key=lambda r: r["_part"])
    names, at, rows = ["rank", *sums], dict.fromkeys(["rank", *sums], 0), []
    for r in per:
        rows.append((r["_part"], *(at[n] for n in names)))
        at = {n: at[n] + (r[n] or 0) for n in names}
    schema = "_part int, _rank long" + "".join(f", _{n} long" for n in sums)
    starts = df.sparkSession.createDataFrame(rows, schema)
    w = Window.partitionBy("_part").orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(starts), "_part")  # a row for each partition
    out = out.withColumn("rank", F.col("_rank") + F.row_number().over(w) - 1)
    for n, c in sums.items():
        out = out.withColumn(n, F.col(f"_{n}") + F.coalesce(F.sum(c).over(before), F.lit(0)))
    return out.select(*df.columns, *names)
