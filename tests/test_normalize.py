import datetime

import pytest
from pyspark.sql import functions as F

from heronwatch.functions import normalize as n

CASES = [
    (n.number, "94,4", 94.4), (n.number, " 12% ", 12.0), (n.number, "1.234,5", 1.2345), (n.number, "1,234.5", 1234.5), (n.number, "1,234,567", None), (n.number, "inf", None),
    (n.number, "NaN", None), (n.number, "1_000", None), (n.number, "1d", None), (n.number, "N/A", None), (n.number, None, None), (n.integer, "2.5", 2), (n.integer, "3.5", 4),
    (n.boolean, "sí", True), (n.boolean, "x", False), (n.boolean, "s/i", None), (n.date, "31/02/2026", None), (n.date, "1/2/2026", datetime.date(2026, 2, 1)), (n.date, "2026/08/01", datetime.date(2026, 8, 1)),
    (n.date, "2026-08-01 10:00:00", datetime.date(2026, 8, 1)), (n.date, "1-2-26", None), (n.period, "ago-2026", "2026-08"), (n.period, "ago.-2026", "2026-08"), (n.period, "8/2026", "2026-08"),
    (n.period, "2026-13", None), (n.period, "2026-8", "2026-08"), (n.bare, "  a\t", "a"), (n.bare, "--", None),
]


def test_cells(spark):
    rows = spark.createDataFrame([(i, c[1]) for i, c in enumerate(CASES)], "i int, x string")
    got = {}
    for fn in {c[0] for c in CASES}:
        got |= {(fn, r.i): r.v for r in rows.select("i", fn(F.col("x")).alias("v")).collect()}
    for i, (fn, x, want) in enumerate(CASES):
        assert got[fn, i] == (pytest.approx(want) if isinstance(want, float) else want), (fn.__name__, x)


def test_contract(spark):
    from heronwatch.operators import validate
    from heronwatch.plans.intake import SHEET
    from heronwatch.sources.contracts import ContractError, conform

    raw = spark.createDataFrame(
        [(1, " P10001 ", "2026-08", "94,4", "4.2", "30", "120"), (2, "P10001", "ago-2026", "90", "4", "10", "5"), (3, "P10002", "08/2026", "999", "4", "1", "1"), (4, "P10003", "2026-8", "80", "0", "s/i", "-"), (5, "P10004", "2026-13", "80", "4", "1", "1"), (6, "P1", "2026-08", "N/A", "4", "1", "1")],
        "_row long, person_code string, `month_text ` string, prod_text string, csat_text string, nps_text string, days_text string",
    )
    rows = validate.judged(conform(raw.withColumn("email", F.lit("x")), SHEET), SHEET)
    got = {r["_row"]: r for r in rows.collect()}
    assert [got[i].reject_reason for i in range(1, 7)] == [None, None, "productivity: range", None, "period: missing", "person: pattern"]
    assert got[1].person == "P10001" and got[1].productivity == 94.4 and got[4].csat is None and got[4].nps is None and "email" not in rows.columns
    s = validate.summary(rows, SHEET).first()
    assert (s.rows_in, s.valid, s.rejected, s.repeats) == (6, 2, 3, 1)
    with pytest.raises(ContractError, match="3 of 6"):
        validate.stop_if_bad(rows, SHEET)
    with pytest.raises(ContractError, match="lacks"):
        conform(raw.drop("nps_text"), SHEET)


def test_landing_counts_while_it_writes(spark, tmp_path):
    from heronwatch.operators import validate
    from heronwatch.plans.intake import SHEET
    from heronwatch.sources.contracts import ContractError, conform

    raw = spark.createDataFrame(
        [(1, " P10001 ", "2026-08", "94,4", "4.2", "30", "120"), (2, "P10002", "ago-2026", "90", "9", "N/A", "5"), (3, "P10003", "08/2026", "999", "4", "1", "1"), (4, "P10004", "2026-13", "80", "4", "1", None)],
        "_row long, person_code string, month_text string, prod_text string, csat_text string, nps_text string, days_text string",
    )
    rows = conform(raw, SHEET)
    done = validate.land(rows, SHEET, str(tmp_path / "a"), most=0.5)
    assert sorted(r["_row"] for r in done.clean.collect()) == [1, 2] and {r["_row"]: r.reject_reason for r in done.quarantine.collect()} == {3: "productivity: range", 4: "period: missing"}
    got = {(r.kind, r.column, r.detail): r.rows for r in done.report().collect()}
    assert got == {
        ("rows_in", "", ""): 4, ("rejected", "", ""): 2, ("reject", "productivity", "range"): 1, ("reject", "period", "missing"): 1, ("stray_spaces", "person", ""): 1, ("written_null", "nps", "N/A"): 1,
        ("decimal_comma", "productivity", ""): 1, ("period_shape", "period", ""): 2, ("made_null", "csat", ""): 1, ("optional_null", "nps", ""): 1, ("optional_null", "days", ""): 1,
    }
    with pytest.raises(ContractError, match="2 of 4 rows rejected; period: missing \\(1\\), productivity: range \\(1\\)"):
        validate.land(rows, SHEET, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).where("rejected = 'true'").count() == 2  # there to look at
    assert validate.land(rows.limit(0), SHEET, str(tmp_path / "c")).counts["rows_in", "", ""] == 0
