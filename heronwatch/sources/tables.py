"""Writing and reading whole tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_folder(spark: SparkSession) -> str:
    """The folder all machines share (``spark.checkpoint.dir``), or a temporary one in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def staged(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` written as Parquet and read back: a table that several steps share is made once."""
    path = f"{work_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replace(df: DataFrame, path: str, *partition_by: str) -> None:
    """Overwrite a table; with partitions, only those that ``df`` has."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.parquet(path)


def append(df: DataFrame, path: str, *partition_by: str) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def stamp(spark: SparkSession, paths: list[str]) -> str:
    """Says whether files are still the same: their number, names, sizes and times, in one row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path", "length", "modificationTime")
    r = files.agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.bit_xor(F.xxhash64("path", "length", "modificationTime")).alias("mark")).first()
    return f"{r.n} {r.bytes} {r.mark}"


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table: table, rows."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out
