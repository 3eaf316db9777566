"""Structured readings of notes: which notes to read, whether a reading holds, which one to show."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The closed lists of a reading.
TONES = ["positive", "neutral", "negative", "insufficient"]
TOPICS = ["load", "pay", "growth", "leader", "team", "process", "tools", "recognition", "balance", "change", "health", "clients"]
SCHEMA = "hash string, tone string, topics array<string>, signals array<string>, quotes array<string>, confidence double"


def notes_in_window(notes: DataFrame, alerts: DataFrame, before: int = 3) -> DataFrame:
    """Notes of alerted people from the months up to their last alert."""
    last = alerts.groupBy("person_id").agg(F.max("idx").alias("alert_idx"))
    return notes.join(last, "person_id").where((F.col("idx") <= F.col("alert_idx")) & (F.col("idx") > F.col("alert_idx") - before))


def unread(notes: DataFrame, done: DataFrame, most: int) -> DataFrame:
    """One note for each hash that has no reading yet, the first ``most`` by month and id."""
    w = Window.partitionBy("hash").orderBy("idx", "note_id")
    new = notes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").join(done.select("hash").distinct(), "hash", "left_anti")
    return new.orderBy("idx", "note_id").limit(most)


def with_notes(notes: DataFrame, readings: DataFrame) -> DataFrame:
    """Every note with the reading of its content: notes of one content share it."""
    return notes.join(readings, "hash")


def judged(readings: DataFrame) -> DataFrame:
    """Readings with the redacted ``text`` they stand for, and ``reject_reason``: the first rule
    that does not hold. A reading that fails counts as not processed."""
    a = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    rules = [
        ("tone", F.coalesce(~F.col("tone").isin(TONES), F.lit(True))),
        ("topics", F.size(F.array_except(a("topics"), F.array(*map(F.lit, TOPICS)))) > 0),
        ("too many", F.greatest(F.size(a("topics")), F.size(a("signals")), F.size(a("quotes"))) > 3),
        ("signals", F.size(F.array_except(a("signals"), a("topics"))) > 0),
        ("quotes", ~F.forall(a("quotes"), lambda q: F.coalesce(F.contains(F.col("text"), q), F.lit(False)))),
        ("confidence", ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))),
        ("insufficient", (F.col("tone") == "insufficient") & (F.size(F.concat(a("topics"), a("signals"), a("quotes"))) > 0)),
    ]
    reason = F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in rules])
    return readings.withColumn("reject_reason", reason).withColumn("tone", F.when(reason.isNull(), F.col("tone")).otherwise("not processed"))


def latest_reading(alerts: DataFrame, readings: DataFrame, window: int = 3) -> DataFrame:
    """Each alert with the latest reading of its person within the window, never a later one."""
    r = readings.select("person_id", F.col("idx").alias("read_idx"), "note_id", "hash", "tone", "topics", "quotes")
    joined = alerts.join(r, (alerts["person_id"] == r["person_id"]) & (r["read_idx"] <= alerts["idx"]) & (r["read_idx"] > alerts["idx"] - window), "left").drop(r["person_id"])
    w = Window.partitionBy("person_id", "idx").orderBy(F.desc_nulls_last("read_idx"), F.desc("note_id"), "hash")
    return joined.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def evaluated(readings: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """Tone accuracy, topic overlap and share not processed on a repeatable sample by hash."""
    seen = readings.join(labels, "note_id").orderBy("hash", "note_id").limit(n)
    m = lambda c: F.try_divide(F.sum(F.coalesce(c, F.lit(False)).cast("long")).cast("double"), F.count("*").cast("double"))
    return seen.agg(F.count("*").alias("notes"), m(F.col("tone") == F.col("real_tone")).alias("tone_accuracy"), m(F.arrays_overlap("topics", "real_topics")).alias("topic_overlap"), m(F.col("tone") == "not processed").alias("not_processed"))
