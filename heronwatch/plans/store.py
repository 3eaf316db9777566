"""Tables that several jobs read, made once for given inputs and kept by month."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import tables
from ..sources.testbed import DEFINITIONS

INPUTS = sorted({t for read, _ in DEFINITIONS.values() for t in read})
#: (application, folder, table): the state of the inputs it was made from, its path and schema.
_kept: dict[tuple[str, str, str], tuple[str, str, T.StructType]] = {}


def kept(spark: SparkSession, sf_dir: str, name: str, build: Callable[[SparkSession, str], DataFrame], by: str = "idx", dealt: bool = False) -> DataFrame:
    """The table ``name`` of ``sf_dir``, partitioned by ``by``: read if this application has made it
    from the inputs as they are, else made. A filter on ``by`` reads only its partitions. Rows are
    gathered by ``by`` before they are written, unless they are ``dealt`` over few large tasks, which
    then write a file for each partition: a wide table is not exchanged whole for that."""
    key, now = (spark.sparkContext.applicationId, sf_dir, name), tables.stamp(spark, [f"{sf_dir}/{t}.parquet" for t in INPUTS])
    if key in _kept and _kept[key][0] == now:
        try:
            return spark.read.schema(_kept[key][2]).parquet(_kept[key][1])
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # a cleared folder: made again
                raise
    rows, path = build(spark, sf_dir), f"{tables.work_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = T.StructType([f for f in rows.schema if f.name != by] + [rows.schema[by]])
    tables.replace(rows if dealt else rows.hint("rebalance", F.col(by)), path, by)
    _kept[key] = (now, path, schema)
    return spark.read.schema(schema).parquet(path)
