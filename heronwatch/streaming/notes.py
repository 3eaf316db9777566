"""Notes that arrive in files: redacted, hashed, without repeats, each once in the sink.

The sink has two tables. ``rows`` is partitioned by the first digits of the hash and by the attempt
that wrote them; ``commits`` names the attempt of each batch of each stream, one row, written last.
Only committed attempts are read, so what a batch that died has left is never seen, and a batch
that was committed is not written again when the stream replays it. A batch looks for its hashes
only in the parts of the sink that it touches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.redaction import content_hash, masked_patterns
from ..sources.tables import append, staged

#: Digits of the hash that name a part of the sink: 256 parts.
PREFIX = 2
COMMITS = "stream string, batch long, attempt string"


def redacted(notes: DataFrame, clients: list[str] = ()) -> DataFrame:
    text = masked_patterns(F.col("text"), clients)
    return notes.withColumn("text", text).withColumn("hash", content_hash(F.col("text")))


def sink_schema(source: StructType) -> StructType:
    return StructType([*source.fields, *[StructField(n, StringType()) for n in ("hash", "prefix", "attempt")]])


def committed(spark: SparkSession, sink: str, source: StructType) -> DataFrame:
    """The rows of the sink whose attempt was committed; ``source`` is the schema of the notes."""
    done = spark.read.schema(COMMITS).parquet(f"{sink}/commits").select("attempt").distinct()
    return spark.read.schema(sink_schema(source)).parquet(f"{sink}/rows").join(done, "attempt", "left_semi")


def commit(spark: SparkSession, sink: str, stream: str, batch: int, attempt: str) -> None:
    append(spark.createDataFrame([(stream, batch, attempt)], COMMITS), f"{sink}/commits")


def ingest(spark: SparkSession, source: str, schema: StructType, sink: str, checkpoint: str, clients: list[str] = (), delay: str = "1 hour") -> StreamingQuery:
    """Start a run over the files that are there; notes need a timestamp ``ts``. Notes later than
    the watermark are left out; a hash that the sink has comes no second time."""
    spark.createDataFrame([], sink_schema(schema)).write.mode("ignore").partitionBy("prefix", "attempt").parquet(f"{sink}/rows")
    spark.createDataFrame([], COMMITS).write.mode("ignore").parquet(f"{sink}/commits")
    stream = spark.readStream.schema(schema).parquet(source)
    new = redacted(stream, clients).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["hash"])

    def write(batch: DataFrame, number: int) -> None:
        own = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        done = spark.read.schema(COMMITS).parquet(f"{sink}/commits").where((F.col("stream") == own) & (F.col("batch") == number))
        if done.take(1):
            batch.write.format("noop").mode("overwrite").save()  # the stream's own state still has to be written
            return
        attempt = uuid.uuid4().hex
        one = staged(batch.dropDuplicates(["hash"]).withColumn("prefix", F.substring("hash", 1, PREFIX)))
        touched = [r.prefix for r in one.select("prefix").distinct().collect()]  # no more than there are parts
        known = committed(spark, sink, schema).where(F.col("prefix").isin(touched)).select("hash")
        append(one.join(known, "hash", "left_anti").withColumn("attempt", F.lit(attempt)), f"{sink}/rows", "prefix", "attempt")
        commit(spark, sink, own, number, attempt)

    return new.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
