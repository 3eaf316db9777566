"""What only larger tables show: ids beyond five digits, how often wide rows are exchanged and written."""

import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from heronwatch.operators import person_month as pm
from heronwatch.operators import validate
from heronwatch.plans import audits, people, store
from heronwatch.sources.contracts import Contract, Field, conform
from heronwatch.sources.testbed import LAST_MONTH, staging


def same_as_sql(spark, folder, name):
    """Rows of the query, after they are found equal to those of its SQL."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}{'/*.parquet' if f.is_dir() else ''}')")
    found = entry.queries()[name](spark, str(folder))
    told = con.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in told.description].index(c) for c in found.columns]
    got = sorted(map(tuple, found.collect()), key=str)
    assert got == sorted((tuple(r[i] for i in at) for r in told.fetchall()), key=str)
    return got


def test_orphans_of_long_ids(spark, small, tmp_path):
    later = F.lit(99_960)
    for name, keys in (("customer", ["c_custkey"]), ("orders", ["o_custkey"]), ("lineitem", []), ("nation", []), ("region", [])):
        rows = spark.read.parquet(f"{small}/{name}.parquet")
        rows.withColumns({k: F.col(k) + later for k in keys}).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert same_as_sql(spark, tmp_path, "sheet_orphans")


def exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


def facts_of(spark, folder):
    return {n: staging(spark, folder, n).cache() for n in ("directory", "exits", "bands", *people.FACTS)}


def test_months_are_dealt_out_once_and_written_once(spark, small, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        facts = facts_of(spark, small)
        found = exchanges(pm.person_months(*[facts[n] for n in ("directory", "exits", "bands", *people.FACTS)], LAST_MONTH, 48))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum("REPARTITION_BY_COL" in line for line in found) == 1 and not any("idx" in line for line in found)

    def twice(*_):
        raise AssertionError("the wide table is written before it is kept")

    monkeypatch.setattr(pm, "staged", twice)
    monkeypatch.setattr(store, "_kept", {})
    assert people.table_360(spark, small).count() == people.spine(spark, small).count()


def test_state_of_months_has_no_exchange_by_month(spark, small):
    from heronwatch.operators import carried

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = exchanges(carried.state_at(facts_of(spark, small), LAST_MONTH - 2, 12))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found and not any("idx" in line for line in found)


KEYED = Contract("keyed", ("who", "day"), {"who": Field("text", True), "day": Field("text"), "n": Field("number", True, low=0)})


def judged_rows(spark):
    rows = [("a", "1", "1"), ("a", "1", "2"), ("a", None, "1"), ("a", None, "3"), ("a", "2", "-4"), (None, "2", "1"), ("b", "1", "x"), ("b", "1", "5")]
    return validate.judged(conform(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_row int, who string, day string, n string"), KEYED), KEYED)


def test_summary_reads_rows_once(spark):
    found = validate.summary(judged_rows(spark), KEYED)
    assert found.columns == ["source", "rows_in", "valid", "rejected", "repeats", "reject_rate"] and found.collect() == [("keyed", 8, 3, 3, 2, 0.375)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Union" not in plan
    assert validate.summary(judged_rows(spark).limit(0), KEYED).collect() == [("keyed", 0, 0, 0, 0, None)]


def test_cells_are_worked_out_once(spark):
    plan = judged_rows(spark).where("reject_reason IS NULL")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 0 and plan.count("RLIKE") <= 2


def test_both_sides_are_written_in_one_pass(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def look(n):
        seen.add(1)
        return n

    rows = judged_rows(spark).withColumn("_row", F.udf(look, "int")("_row"))
    clean, rejected = validate.split_and_write(rows, str(tmp_path))
    assert seen.value == 8
    assert {r._row for r in clean.collect()} == {0, 1, 2, 3, 7} and {r._row for r in rejected.collect()} == {4, 5, 6} and "reject_reason" not in clean.columns


def test_signal_lift_exchanges_flags(spark, small):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = audits.signal_lift(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = next(line for line in plan[plan.index("Join LeftOuter") :].splitlines() if "Project" in line)
    assert "AS f_silent" in join and "person_id" in join and ", training_ratio#" not in join


def test_cooldown_cost_ranks_by_one_quota(spark, small, monkeypatch):
    asked, calibration = [], audits.backtest.calibration

    def watched(*args):
        asked.append(args[6])
        assert set(args[0].columns) == {"person_id", "idx", "period", "channel", "priority", "compa", "idx_before", "priority_before"}
        return calibration(*args)

    monkeypatch.setattr(audits.backtest, "calibration", watched)
    assert {r.cooldown for r in audits.cooldown_cost(spark, small).collect()} <= {3, 6} and asked == [audits.QUOTAS[-1:]]
