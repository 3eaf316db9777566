"""Queries that go through files: sheets read by contract, tables by month, both sides of a
quarantine, readings as JSON, and the sorted sink of the alerts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import readings, rules, validate
from ..sources import tables
from ..sources.contracts import Contract, Field, conform, read_csv, read_json, read_json_files
from ..sources.testbed import LAST_MONTH, staging
from ..streaming import notes as note_stream
from .early_warning import QUEUE, all_alerts, over_alerts
from .intake import SHEET
from .intake import X as SHEETS
from .listening import X as NOTES
from .oracle import with_tables

#: The sheet as people keep it: its headers, in the order of its columns.
HEADERS = {" Fila": "_row", "Persona ": "person", "Mes": "period", "Productividad": "productivity", "CSAT": "csat", "NPS ": "nps", "Días": "days"}
BY_HAND = Contract(SHEET.name, SHEET.key, SHEET.fields, {h.strip(): n for h, n in HEADERS.items()})
NOTE_SHEET = Contract(
    "notes_sheet", ("note",),
    {"note": Field("integer", True, low=0), "lang": Field("text", True, domain=("en", "de", "fr")), "author": Field("text", pattern="^src[0-9]+$"), "text": Field("text", True, least_length=400)},
    {"doc_id": "note", "source": "author"},
)


def _folder(spark) -> str:
    return f"{tables.work_folder(spark)}/{uuid.uuid4().hex}"


def sheet_from_csv(spark, sf_dir):
    """The sheet from CSV files by its contract: all text, headers renamed, undeclared columns left, then typed."""
    path = _folder(spark)
    names = dict(zip(["_row", *SHEET.headers], HEADERS, strict=True))
    raw = staging(spark, sf_dir, "sheet").select("*", F.lit("x@y.z").alias("email")).withColumnsRenamed(names)
    raw.write.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path, header=True)
    rows = validate.judged(conform(read_csv(spark, path, [*HEADERS, "email"]), BY_HAND), BY_HAND).where("reject_reason IS NULL")
    return rows.select(F.col("_row").cast("long").alias("_row"), *[F.col(f.name).cast(f.dataType) for f in BY_HAND.schema()])


def months_replaced(spark, sf_dir):
    """Metrics by month: a table partitioned by month, its last months replaced, one month appended."""
    path, rows = _folder(spark), staging(spark, sf_dir, "metrics").select("person_id", "productivity", "idx")
    tables.replace(rows, path, "idx")
    tables.replace(rows.where(F.col("idx") > LAST_MONTH - 3).withColumn("productivity", F.col("productivity") + 100), path, "idx")
    tables.append(rows.where(F.col("idx") == LAST_MONTH - 12).withColumn("idx", F.lit(LAST_MONTH + 9).cast("long")), path, "idx")
    found = spark.read.schema(rows.schema).parquet(path)
    return found.groupBy("idx").agg(F.count("*").alias("rows"), F.sum(F.round(F.col("productivity") * 10).cast("long")).alias("tenths"))


def quarantine(spark, sf_dir):
    """Clean and rejected rows, each written to its table and read back."""
    clean, rejected = validate.split_and_write(validate.judged(conform(staging(spark, sf_dir, "sheet"), SHEET), SHEET), _folder(spark))
    return rejected.groupBy("reject_reason").agg(F.count("*").alias("rows"), F.min("_row").alias("first_row")).unionByName(
        clean.agg(F.lit(None).cast("string").alias("reject_reason"), F.count("*").alias("rows"), F.min("_row").alias("first_row"))
    )


def notes_sheet(spark, sf_dir):
    """Notes as a sheet with a closed list and a least length: reasons to reject (V4, V7)."""
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text")
    return validate.judged(conform(raw, NOTE_SHEET), NOTE_SHEET).select("note", "lang", "author", F.length("text").alias("length"), "reject_reason")


def readings_by_hash(spark, sf_dir):
    """Readings kept as JSON files, joined with the redacted notes by content hash."""
    path = _folder(spark)
    made = note_stream.redacted(staging(spark, sf_dir, "made_readings"))
    kept = made.groupBy("hash").agg(F.min_by(F.struct("tone", "topic", "confidence"), "note_id").alias("x"))
    kept.select("hash", "x.tone", F.array("x.topic").alias("topics"), F.array().cast("array<string>").alias("signals"), F.array().cast("array<string>").alias("quotes"), "x.confidence").write.json(path)
    found = read_json(spark, path, readings.SCHEMA)
    return readings.with_notes(made.select("note_id", "idx", "hash", F.length("text").alias("length")), found).select("note_id", "idx", "hash", "length", "tone", F.concat_ws(",", "topics").alias("topics"), "confidence")


#: Readings in a file, about; of every so many files one breaks off, and one has an object without hash.
IN_FILE, BROKEN = 50, 7


def readings_from_files(spark, sf_dir):
    """Readings in files of indented objects, of which some are broken: what each file gives."""
    path = _folder(spark)
    made = note_stream.redacted(staging(spark, sf_dir, "made_readings"))
    kept = made.groupBy("hash").agg(F.min_by(F.struct("tone", "topic", "confidence"), "note_id").alias("x"))
    one = kept.select("hash", "x.tone", F.array("x.topic").alias("topics"), F.array().cast("array<string>").alias("signals"), F.array().cast("array<string>").alias("quotes"), "x.confidence")
    files = one.withColumn("file", F.conv(F.substring("hash", 1, 6), 16, 10).cast("long") % F.lit(-(-kept.count() // IN_FILE)))
    named = F.when((F.col("file") % BROKEN == 4) & F.col("hash").like("%0"), F.lit(None)).otherwise(F.col("hash")).alias("hash")
    text = F.to_json(F.struct(named, *one.columns[1:]), {"pretty": "true"})
    whole = files.select("file", text.alias("text")).groupBy("file").agg(F.concat(F.lit("[\n"), F.array_join(F.sort_array(F.collect_list("text")), ",\n"), F.lit("\n]")).alias("value"))
    cut = F.when(F.col("file") % BROKEN == 2, F.substring("value", 1, F.length("value") - 20)).otherwise(F.col("value"))
    whole.select("file", cut.alias("value")).repartition("file").write.partitionBy("file").text(path)
    found = tables.staged(read_json_files(spark, path, readings.SCHEMA, "hash"))
    clean, rejected = found.where("reject_reason IS NULL"), found.where("reject_reason IS NOT NULL")
    tables.replace(rejected.select("file", "reject_reason"), _folder(spark))
    number = F.regexp_extract("file", "file=(\\d+)/", 1).cast("long").alias("number")
    rows = clean.select(number, F.lit(None).cast("string").alias("reject_reason"), "topics").unionByName(rejected.select(number, "reject_reason", "topics"))
    return rows.groupBy("number", "reject_reason").agg(F.count("*").alias("rows"), F.count(F.when(F.array_contains("topics", "pay"), 1)).alias("on_pay"))


def alerts_sink(spark, sf_dir):
    """The alerts as written: guarded, then in the order of month, channel and position."""
    path, rows = _folder(spark), tables.staged(all_alerts(spark, sf_dir).select(*QUEUE))
    rules.guard_dimensions(rows)
    tables.replace(rows.orderBy(F.desc("period"), "channel", "position"), path)
    return spark.read.schema(rows.schema).parquet(path)


QUERIES = {f.__name__: f for f in (sheet_from_csv, months_replaced, quarantine, notes_sheet, readings_by_hash, readings_from_files, alerts_sink)}

_strip = lambda c: f"regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
SQL = {
    "sheet_from_csv": with_tables("SELECT _row, person, period, productivity, csat, nps, days FROM jd WHERE reject_reason IS NULL", "jd", extra=SHEETS),
    "months_replaced": with_tables(
        f"""SELECT idx, count(*) AS rows, sum(round(productivity * 10)::BIGINT)::BIGINT AS tenths FROM (
          SELECT idx, CASE WHEN idx > {LAST_MONTH - 3} THEN productivity + 100 ELSE productivity END AS productivity FROM metrics UNION ALL SELECT {LAST_MONTH + 9}, productivity FROM metrics WHERE idx = {LAST_MONTH - 12}) GROUP BY 1""",
        "metrics",
    ),
    "quarantine": with_tables("SELECT reject_reason, count(*) AS rows, min(_row) AS first_row FROM jd GROUP BY 1", "jd", extra=SHEETS),
    "notes_sheet": f"""SELECT doc_id AS note, lang, source AS author, length(t) AS length,
      CASE WHEN doc_id IS NULL THEN 'note: missing' WHEN lang IS NULL THEN 'lang: missing' WHEN lang NOT IN ('en', 'de', 'fr') THEN 'lang: domain' WHEN NOT regexp_matches(source, '^src[0-9]+$') THEN 'author: pattern'
        WHEN t IS NULL THEN 'text: missing' WHEN length(t) < 400 THEN 'text: short' END AS reject_reason
      FROM (SELECT *, nullif({_strip('text')}, '') AS t FROM documents)""",
    "readings_by_hash": with_tables(
        "SELECT n.note_id, n.idx, n.hash, length(n.r) AS length, k.tone, k.topic AS topics, k.confidence FROM rh n JOIN (SELECT hash, unnest(min_by({tone: tone, topic: topic, confidence: confidence}, note_id)) FROM rh GROUP BY 1) k USING (hash)",
        "rh", extra=NOTES | {"rh": (("rd",), "SELECT m.*, rd.r, substr(sha256(rd.r), 1, 24) AS hash FROM made_readings m JOIN rd USING (note_id)")},
    ),
    "readings_from_files": with_tables(
        f"""SELECT number, reject_reason, CASE WHEN reject_reason = 'not readable' THEN 1 ELSE count(*) END AS rows, CASE WHEN reject_reason = 'not readable' THEN 0 ELSE count(*) FILTER (topic = 'pay') END AS on_pay
        FROM (SELECT *, CASE WHEN number % {BROKEN} = 2 THEN 'not readable' WHEN number % {BROKEN} = 4 AND hash LIKE '%0' THEN 'hash: missing' END AS reject_reason FROM (SELECT *, ('0x' || substr(hash, 1, 6))::BIGINT % ((count(*) OVER () + {IN_FILE - 1}) // {IN_FILE}) AS number
          FROM (SELECT hash, min_by(topic, note_id) AS topic FROM rh GROUP BY 1))) GROUP BY number, reject_reason""",
        "rh", extra=NOTES | {"rh": (("rd",), "SELECT m.*, rd.r, substr(sha256(rd.r), 1, 24) AS hash FROM made_readings m JOIN rd USING (note_id)")},
    ),
    "alerts_sink": over_alerts(f"SELECT {', '.join(QUEUE)} FROM al"),
}
