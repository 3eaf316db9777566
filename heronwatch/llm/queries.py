"""Registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import jaccard, line_quality, phrases, vector_codes
from .storage import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import minhash

    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.query(table(spark, sf_dir, "documents"))


def op3_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_text

    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import masked_lm

    return masked_lm.score(table(spark, sf_dir, "documents"))


def op5_lookup_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lookup_sketch

    return lookup_sketch.query(table(spark, sf_dir, "documents"))


def op6_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.query(table(spark, sf_dir, "documents"))


def op7_cover_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import passages

    return passages.query(table(spark, sf_dir, "documents"))


def op9_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffixes

    return suffixes.query(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import bpe

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_range_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import shards

    return shards.by_bytes(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), words=3, percent=90)


def op13_son_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_minhash_forest": op1_minhash_forest,
    "op2_line_quality": op2_line_quality,
    "op3_site_templates": op3_site_templates,
    "op4_masked_lm": op4_masked_lm,
    "op5_lookup_sketch": op5_lookup_sketch,
    "op6_cube_mix": op6_cube_mix,
    "op7_cover_anchors": op7_cover_anchors,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_suffix_sort": op9_suffix_sort,
    "op10_range_shards": op10_range_shards,
    "op11_vector_codes": op11_vector_codes,
    "op12_prefix_join": op12_prefix_join,
    "op13_son_phrases": op13_son_phrases,
}

SQL: dict[str, str] = {
    "op2_line_quality": line_quality.SQL,
    "op11_vector_codes": vector_codes.SQL,
    "op12_prefix_join": jaccard.sql(words=3, percent=90),
    "op13_son_phrases": phrases.SQL,
}
