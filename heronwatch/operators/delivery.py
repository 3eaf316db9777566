"""What a person in charge gets to see: a card for each notified alert, as nested JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENTENCE_END = "(?<=[.:])\\s+"


def with_blind_spots(alerts: DataFrame) -> DataFrame:
    """``blind_spots``: what the alert cannot know."""
    spots = F.array_compact(F.array(
        F.when(F.coalesce("months_since_note", F.lit(99)) >= 3, F.lit("No note for three months or more.")),
        F.when(F.col("csat_avg_3m").isNull(), F.lit("No customer score.")),
        F.when(F.col("prod_avg_3m").isNull(), F.lit("No productivity figure.")),
        F.when(F.col("tenure") < 12, F.lit("Less than a year with us.")),
    ))
    return alerts.withColumn("blind_spots", F.when(F.size(spots) == 0, F.array(F.lit("None known."))).otherwise(spots))


def sentences(text: str):
    return F.filter(F.transform(F.split(text, SENTENCE_END), lambda s: F.btrim(s)), lambda s: s != "")


def with_context(alerts: DataFrame, topics: int = 2, quotes: int = 1) -> DataFrame:
    """Topics and quotes cut to what may be shown; nothing where there is no reading."""
    shown = F.coalesce(~F.col("tone").isin("not processed", "insufficient"), F.lit(False))
    cut = lambda c, n: F.when(shown, F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, n)).otherwise(F.array().cast("array<string>"))
    return alerts.withColumns({"shown_topics": cut("topics", topics), "shown_quotes": cut("quotes", quotes)})


def cards(alerts: DataFrame, names: DataFrame) -> DataFrame:
    """person_id, period, card (JSON with its sections in a fixed order)."""
    named = alerts.join(names.select("person_id", "name"), "person_id", "left")
    card = F.struct(
        F.coalesce("name", F.col("person_id").cast("string")).alias("who"), F.struct("rule", "rule_name", "rule_level").alias("rule"),
        F.transform(F.arrays_zip("signals", "evidence"), lambda x: F.struct(x["signals"].alias("signal"), x["evidence"].alias("evidence"))).alias("signs"),
        "blind_spots", F.struct(F.col("shown_topics").alias("topics"), F.col("shown_quotes").alias("quotes")).alias("context"), sentences("rule_action").alias("steps"),
    )
    return named.select("person_id", "period", F.to_json(card).alias("card"))
