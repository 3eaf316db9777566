"""Figures that an earlier run published, against the same figures worked out again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import append

SCHEMA = "run string, name string, value double"


class FiguresDiffer(ValueError):
    """A published figure does not hold."""


def named(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """name, value of an aggregate: one figure for each row and column of ``values``."""
    one = F.explode(F.array(*[F.struct(F.concat_ws("/", F.lit(v), *keys).alias("name"), F.col(v).cast("double").alias("value")) for v in values])).alias("x")
    return rows.select(one).select("x.name", "x.value")


def publish(found: DataFrame, path: str, run: str) -> None:
    """Add the figures of a run to the published ones."""
    append(found.select(F.lit(run).alias("run"), "name", "value"), path)


def published(spark: SparkSession, path: str, run: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path).where(F.col("run") == run).select("name", "value")


def reconciled(before: DataFrame, now: DataFrame, tolerance: float = 1e-9, by_name: dict[str, float] | None = None) -> DataFrame:
    """name, published, recomputed, tolerance, ok. A figure that one side lacks is not ok; a
    tolerance of its own goes by the first part of the name."""
    own = F.lit(tolerance)
    for kind, t in (by_name or {}).items():
        own = F.when(F.split_part("name", F.lit("/"), F.lit(1)) == kind, F.lit(t)).otherwise(own)
    both = before.select("name", F.col("value").alias("published")).join(now.select("name", F.col("value").alias("recomputed")), "name", "full")
    return both.withColumn("tolerance", own).withColumn("ok", F.coalesce(F.abs(F.col("published") - F.col("recomputed")) <= F.col("tolerance"), F.lit(False)))


def stop_if_off(found: DataFrame) -> None:
    if bad := found.where("NOT ok").orderBy("name").limit(5).collect():
        raise FiguresDiffer("; ".join(f"{r.name}: published {r.published}, now {r.recomputed}" for r in bad))
