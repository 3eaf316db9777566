import hashlib

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from heronwatch.functions import redaction
from heronwatch.operators import delivery, diff, figures, readings
from heronwatch.streaming import notes


def test_redaction(spark):
    text = "Ana Soto (P10001, ana@x.com) asked $1.200 for Acme Corp, and Ana Soto met Luis."
    rows = spark.createDataFrame([(1, text), (2, None), (3, "Anabel del Carmen")], "note_id int, text string")
    masked = rows.withColumn("text", redaction.masked_patterns(F.col("text"), ["Acme", "Acme Corp"]))
    people = spark.createDataFrame([("Ana Soto",), ("Luis del Carmen",)], "name string")
    names = redaction.name_dictionary(people)
    assert {r.name for r in names.collect()} == {"Ana Soto", "Ana", "Soto", "Luis del Carmen", "Luis", "Carmen"}
    got = {r.note_id: r for r in redaction.masked_names(masked, names).withColumn("hash", redaction.content_hash(F.col("text"))).collect()}
    assert got[1].text == "[PERSON_1] ([ID], [EMAIL]) asked [AMOUNT] for [CLIENT], and [PERSON_1] met [PERSON_2]."
    assert got[1].hash == hashlib.sha256(got[1].text.encode()).hexdigest()[:24] and got[2].text is None and got[3].text == "Anabel del [PERSON_1]"
    many = spark.createDataFrame([(["Ana"],)] * 30, "matches array<string>")
    with pytest.raises(ValueError, match="Ana"):
        redaction.stop_if_one_name_rules(many)


def test_readings(spark):
    ok = dict(text="they said yes", tone="negative", topics=["load"], signals=["load"], quotes=["said"], confidence=0.5)
    bad = [("tone", {"tone": "angry"}), ("topics", {"topics": ["weather"]}), ("too many", {"quotes": ["said"] * 4}), ("signals", {"signals": ["pay"]}), ("quotes", {"quotes": ["no"]}), ("confidence", {"confidence": 1.2}), ("insufficient", {"tone": "insufficient"})]
    rows = spark.createDataFrame([(i, *(ok | c).values()) for i, (_, c) in enumerate([(None, {}), *bad])], "i int, text string, tone string, topics array<string>, signals array<string>, quotes array<string>, confidence double")
    assert [r.reject_reason for r in readings.judged(rows).orderBy("i").collect()] == [None, *(n for n, _ in bad)]


def test_latest_reading_is_never_from_the_future(spark):
    alerts = spark.createDataFrame([(1, 10), (2, 10)], "person_id long, idx long")
    r = spark.createDataFrame([(1, 9, 1, "a"), (1, 11, 2, "b"), (1, 7, 3, "c"), (2, 7, 4, "d")], "person_id long, idx long, note_id long, hash string").withColumns({"tone": F.lit("neutral"), "topics": F.array(F.lit("pay")), "quotes": F.array(F.lit("q"))})
    assert {(x.person_id, x.note_id) for x in readings.latest_reading(alerts, r).collect()} == {(1, 1), (2, None)}


def test_sentences(spark):
    assert spark.createDataFrame([("Ask first: then talk. ",)], "t string").select(delivery.sentences("t")).first()[0] == ["Ask first:", "then talk."]


def test_diff(spark):
    a = spark.createDataFrame([(1, 1.0, None, [1]), (2, 2.0, "x", [2])], "k int, d double, s string, l array<int>")
    b = spark.createDataFrame([(1, 1.0 + 1e-12, None, [1]), (2, 2.0 + 1e-6, "y", [2])], "k int, d double, s string, l array<int>")
    assert {r["column"]: r.differ for r in diff.cell_diff(a, b, ["k"]).collect()} == {"d": 1, "s": 1, "l": 0}
    assert {r["column"]: r.differ for r in diff.cell_diff(a, b.where("k = 1"), ["k"]).collect()} == {"d": 1, "s": 1, "l": 1}
    with pytest.raises(diff.TablesDiffer):
        diff.check_shape(a, b.drop("s"))
    with pytest.raises(diff.TablesDiffer):
        diff.check_shape(a, b.where("k = 1"))


def _note_files(spark, path, rows):
    out = spark.createDataFrame([(i, t, s) for i, t, s in rows], "note_id int, text string, s long").select("note_id", "text", F.timestamp_seconds("s").alias("ts"))
    out.coalesce(1).write.mode("append").parquet(path)
    return out.schema


def test_stream_adds_nothing_twice(spark, tmp_path):
    schema = _note_files(spark, f"{tmp_path}/in", [(1, "a", 1_700_000_000), (2, "b", 1_700_000_000), (3, "a", 1_700_000_000)])
    for state in ("s1", "s2"):  # the second run starts without memory of the first
        notes.ingest(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/{state}").awaitTermination()
    assert notes.committed(spark, f"{tmp_path}/out", schema).count() == 2


def test_a_batch_that_dies_before_its_commit(spark, tmp_path, monkeypatch):
    schema = _note_files(spark, f"{tmp_path}/in", [(i, f"note {i}", 1_700_000_000 + i) for i in range(40)])
    sink, state, real = f"{tmp_path}/out", f"{tmp_path}/state", notes.commit

    def dies(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(notes, "commit", dies)
    with pytest.raises(StreamingQueryException):
        notes.ingest(spark, f"{tmp_path}/in", schema, sink, state).awaitTermination()
    assert spark.read.schema(notes.sink_schema(schema)).parquet(f"{sink}/rows").count() == 40 and notes.committed(spark, sink, schema).count() == 0
    monkeypatch.setattr(notes, "commit", real)
    notes.ingest(spark, f"{tmp_path}/in", schema, sink, state).awaitTermination()
    got = [r.note_id for r in notes.committed(spark, sink, schema).collect()]
    assert sorted(got) == list(range(40))


def test_a_batch_that_dies_after_its_commit(spark, tmp_path, monkeypatch):
    schema = _note_files(spark, f"{tmp_path}/in", [(i, f"note {i}", 1_700_000_000 + i) for i in range(9)])
    sink, state, real = f"{tmp_path}/out", f"{tmp_path}/state", notes.commit

    def dies(*a):
        real(*a)
        raise RuntimeError("lost")

    monkeypatch.setattr(notes, "commit", dies)
    with pytest.raises(StreamingQueryException):
        notes.ingest(spark, f"{tmp_path}/in", schema, sink, state).awaitTermination()
    monkeypatch.setattr(notes, "commit", real)
    notes.ingest(spark, f"{tmp_path}/in", schema, sink, state).awaitTermination()
    assert notes.committed(spark, sink, schema).count() == 9 and spark.read.schema(notes.COMMITS).parquet(f"{sink}/commits").count() >= 1
    assert spark.read.schema(notes.sink_schema(schema)).parquet(f"{sink}/rows").count() == 9


def test_notes_beyond_the_watermark(spark, tmp_path):
    schema = _note_files(spark, f"{tmp_path}/in", [(1, "now", 1_700_000_000)])
    run = lambda: notes.ingest(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    run()
    _note_files(spark, f"{tmp_path}/in", [(2, "too late", 1_700_000_000 - 7_200), (3, "late", 1_700_000_000 - 1_800), (4, "now", 1_700_000_000 + 5)])
    run()
    assert sorted(r.note_id for r in notes.committed(spark, f"{tmp_path}/out", schema).collect()) == [1, 3]


def test_a_figure_that_is_off(spark, tmp_path):
    counts = spark.createDataFrame([("talk", 10, 2.04), ("pay", 4, 1.0)], "channel string, alerts long, a_month double")
    path = str(tmp_path / "figures")
    figures.publish(figures.named(counts, ["channel"], ["alerts", "a_month"]), path, "2001-06")
    figures.publish(figures.named(counts.limit(0), ["channel"], ["alerts"]), path, "2001-07")
    before = figures.published(spark, path, "2001-06")
    same = figures.named(counts.withColumn("a_month", F.round("a_month", 1)), ["channel"], ["alerts", "a_month"])
    figures.stop_if_off(figures.reconciled(before, same, by_name={"a_month": 0.05}))
    assert [r.name for r in figures.reconciled(before, same).where("NOT ok").collect()] == ["a_month/talk"]
    off = figures.named(counts.withColumn("alerts", F.col("alerts") + (F.col("channel") == "pay").cast("int")), ["channel"], ["alerts", "a_month"])
    with pytest.raises(figures.FiguresDiffer, match="alerts/pay: published 4.0, now 5.0"):
        figures.stop_if_off(figures.reconciled(before, off))
    with pytest.raises(figures.FiguresDiffer, match="alerts/pay: published 4.0, now None"):
        figures.stop_if_off(figures.reconciled(before, off.where("name <> 'alerts/pay'")))
