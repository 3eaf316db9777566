"""Cutting lineage with tables in the folder that every machine of the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; in local mode without it, a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet and read it back: later steps survive lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shielded(docs: DataFrame, *extra: Column) -> DataFrame:
    """``docs`` with its columns named in_0, in_1, ... beside ``extra``: no name can clash."""
    return docs.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(docs.columns)], *extra)


def unshielded(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from ``rows`` made by ``shielded``, under their own names."""
    return rows.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(docs.columns)])
