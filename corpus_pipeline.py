"""From raw documents to token ids: five stages, each an operator of ``heronwatch.llm``.

1. Quality rules: documents that are short, repetitive or mostly boilerplate lines go; the others
   lose their boilerplate lines.
2. Near-duplicates: one document of each group stays (five-word shingles, similarity 0.8).
3. Substring dedup: passages of 50 words that an earlier document has are cut out.
4. Mixing: sources are sampled to their target weights; a row comes as often as it is taken.
5. Byte-level BPE: token ids of every text, checked by decoding them.

Every stage but the last returns the columns of ``documents``; its result is written as Parquet
and read again as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heronwatch.llm import bpe, line_quality, minhash, mixing, passages
from heronwatch.llm.storage import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep(docs, words=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return passages.keep(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.keep(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing", mix),
    ("byte-level BPE", tokenize),
]

#: Passages, sampling and merges have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
