"""Queries of the data contract over the hand-kept sheet."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.normalize import MONTHS, NULL_TOKENS
from ..operators import validate
from ..sources.contracts import Contract, Field, conform
from ..sources.tables import inventory, staged, work_folder
from ..sources.testbed import DEFINITIONS, staging
from .oracle import with_tables

SHEET = Contract(
    "metrics_sheet", ("person", "period"),
    {
        "person": Field("text", True, pattern="^P[0-9]{5}$"), "period": Field("period", True), "productivity": Field("number", True, low=20, high=200),
        "csat": Field("number", low=1, high=5), "nps": Field("integer", low=-100, high=100), "days": Field("integer", low=0, high=1000),
    },
    {"person_code": "person", "month_text": "period", "prod_text": "productivity", "csat_text": "csat", "nps_text": "nps", "days_text": "days"},
)


def _sheet(spark, sf_dir):
    return conform(staging(spark, sf_dir, "sheet"), SHEET)


def sheet_judged(spark, sf_dir):
    """Normalised cells with the reason to reject."""
    return validate.judged(_sheet(spark, sf_dir), SHEET).select("_row", *SHEET.fields, "reject_reason")


def sheet_clean(spark, sf_dir):
    """What goes on: valid and not repeated."""
    rows = validate.judged(_sheet(spark, sf_dir), SHEET).where("reject_reason IS NULL")
    return validate.deduplicated(rows, SHEET).where("NOT repeat").select("_row", *SHEET.fields)


def sheet_summary(spark, sf_dir):
    """Rows in, valid, rejected, repeated."""
    return validate.summary(validate.judged(_sheet(spark, sf_dir), SHEET), SHEET)


def sheet_incidents(spark, sf_dir):
    """What went wrong, by type and column (V9)."""
    sheet = _sheet(spark, sf_dir)
    return validate.incidents(staged(validate.judged(sheet, SHEET)), sheet, SHEET)


def sheet_repairs(spark, sf_dir):
    """Silent repairs by column."""
    return validate.repairs(_sheet(spark, sf_dir), SHEET).withColumn("examples", F.concat_ws("|", "examples"))


def sheet_orphans(spark, sf_dir):
    """Clean rows of people whom the directory lacks; here, the directory ends early."""
    code = F.concat(F.lit("P"), F.lpad(F.col("person_id").cast("string"), 5, "0"))  # as the sheet writes it: five digits, the first ones of a longer id
    people = staging(spark, sf_dir, "directory").where("person_id % 10 <> 0").select(code.alias("person"))
    rows = validate.judged(_sheet(spark, sf_dir), SHEET).where("reject_reason IS NULL")
    return validate.orphans(rows, people, "person")[1].groupBy("person").agg(F.count("*").alias("rows"))


def role_gaps(spark, sf_dir):
    """Roles and countries without a band, if bands of one family were lost."""
    return validate.unmapped(staging(spark, sf_dir, "directory"), staging(spark, sf_dir, "bands").where("family <> 'BUILDING'"), ["family", "country"])


VISITS = Contract(
    "visits_sheet", ("who", "day"), {"who": Field("text", True, pattern="^P[0-9]{5}$"), "day": Field("date", True), "kept": Field("boolean")}, {"day_text": "day", "kept_text": "kept"},
)


def visits_judged(spark, sf_dir):
    """A sheet with dates in five forms and yes or no in many words."""
    return validate.judged(conform(staging(spark, sf_dir, "visits"), VISITS), VISITS).select("_row", "who", "day", "kept", "reject_reason")


#: Rejected rows that the made sheet may have: about one in fifteen are spoilt on purpose.
SPOILT = 0.15


def sheet_landed(spark, sf_dir):
    """The sheet in one pass: clean and quarantine written, everything counted on the way, the gate
    from those counts (S6, N7, V9, V11, V12)."""
    return validate.land(_sheet(spark, sf_dir), SHEET, f"{work_folder(spark)}/landed-{uuid.uuid4().hex}", SPOILT).report()


def table_rows(spark, sf_dir):
    """Rows of every staging table."""
    return inventory({n: staging(spark, sf_dir, n) for n in sorted(DEFINITIONS)})


QUERIES = {f.__name__: f for f in (sheet_judged, sheet_clean, sheet_summary, sheet_incidents, sheet_repairs, sheet_orphans, role_gaps, visits_judged, sheet_landed, table_rows)}

_tokens = ", ".join(f"'{t}'" for t in NULL_TOKENS)
_bare = lambda c: f"CASE WHEN trim({c}) NOT IN ({_tokens}) THEN trim({c}) END"
_num = lambda c: f"try_cast(CASE WHEN contains({c}, ',') AND NOT contains({c}, '.') THEN replace({c}, ',', '.') ELSE replace({c}, ',', '') END AS DOUBLE)"
_month = "CASE " + " ".join(f"WHEN regexp_extract(m, '^([a-z]{{3}})', 1) = '{n}' THEN {i}" for i, n in enumerate(MONTHS, 1)) + " END"
X = {
    "cells": (("sheet",), f"SELECT _row, {_bare('person_code')} AS person, lower({_bare('month_text')}) AS m, replace({_bare('prod_text')}, '%', '') AS p, {_bare('csat_text')} AS c, {_bare('nps_text')} AS n, {_bare('days_text')} AS d FROM sheet"),
    "typed": (("cells",), f"""SELECT _row, person, CASE WHEN mo BETWEEN 1 AND 12 THEN printf('%04d-%02d', yr, mo) END AS period, {_num('p')} AS productivity, {_num('c')} AS csat0, round_even({_num('n')}, 0)::BIGINT AS nps0, round_even({_num('d')}, 0)::BIGINT AS days0 FROM (
        SELECT *, try_cast(regexp_extract(m, '([0-9]{{4}})', 1) AS INT) AS yr, CASE WHEN regexp_matches(m, '^[0-9]{{4}}-') THEN try_cast(regexp_extract(m, '-([0-9]+)$', 1) AS INT) WHEN regexp_matches(m, '^[a-z]') THEN {_month} ELSE try_cast(regexp_extract(m, '^([0-9]+)/', 1) AS INT) END AS mo FROM cells)"""),
    "jd": (("typed",), """SELECT _row, person, period, productivity, CASE WHEN csat0 BETWEEN 1 AND 5 THEN csat0 END AS csat, CASE WHEN nps0 BETWEEN -100 AND 100 THEN nps0 END AS nps, CASE WHEN days0 BETWEEN 0 AND 1000 THEN days0 END AS days, csat0, nps0, days0,
        CASE WHEN person IS NULL THEN 'person: missing' WHEN NOT regexp_matches(person, '^P[0-9]{5}$') THEN 'person: pattern' WHEN period IS NULL THEN 'period: missing' WHEN productivity IS NULL THEN 'productivity: missing' WHEN productivity NOT BETWEEN 20 AND 200 THEN 'productivity: range' END AS reject_reason FROM typed"""),
    "cl": (("jd",), "SELECT *, row_number() OVER (PARTITION BY person, period ORDER BY _row) AS k FROM jd WHERE reject_reason IS NULL"),
}
_cols = "_row, person, period, productivity, csat, nps, days"
_raw = {"person": "person_code", "period": "month_text", "productivity": "prod_text", "csat": "csat_text", "nps": "nps_text", "days": "days_text"}
SQL = {
    "sheet_judged": with_tables(f"SELECT {_cols}, reject_reason FROM jd", "jd", extra=X),
    "sheet_clean": with_tables(f"SELECT {_cols} FROM cl WHERE k = 1", "cl", extra=X),
    "sheet_summary": with_tables(
        "SELECT 'metrics_sheet' AS source, (SELECT count(*) FROM jd) AS rows_in, count(*) FILTER (k = 1) AS valid, (SELECT count(reject_reason) FROM jd) AS rejected, count(*) FILTER (k > 1) AS repeats, (SELECT count(reject_reason)::DOUBLE / count(*) FROM jd) AS reject_rate FROM cl", "cl", extra=X
    ),
    "sheet_incidents": with_tables(
        "SELECT split_part(reject_reason, ': ', 2) AS type, split_part(reject_reason, ': ', 1) AS \"column\", count(*) AS rows FROM jd WHERE reject_reason IS NOT NULL GROUP BY 1, 2 "
        + " ".join(f"UNION ALL SELECT * FROM (SELECT 'optional_null', '{c}', count(*) FILTER ({c}0 IS NULL) AS n FROM jd) WHERE n > 0 UNION ALL SELECT * FROM (SELECT 'made_null', '{c}', count(*) FILTER ({c}0 IS NOT NULL AND {c} IS NULL) AS n FROM jd) WHERE n > 0" for c in ("csat", "nps", "days")),
        "jd", extra=X,
    ),
    "visits_judged": with_tables(
        """SELECT _row, who, day, CASE WHEN _row % 9 < 6 THEN true WHEN _row % 9 <> 7 THEN false END AS kept, CASE WHEN day IS NULL THEN 'day: missing' END AS reject_reason
        FROM (SELECT v.*, CASE WHEN _row % 7 < 5 THEN CAST(o_orderdate AS DATE) END AS day FROM visits v JOIN orders ON o_orderkey = _row)""", "visits",
    ),
    "sheet_landed": with_tables(
        f"""SELECT 'metrics_sheet' AS source, kind, "column", detail, rows FROM (
          SELECT 'rows_in' AS kind, '' AS "column", '' AS detail, count(*) AS rows FROM jd UNION ALL SELECT 'rejected', '', '', count(reject_reason) FROM jd
          UNION ALL SELECT 'reject', split_part(reject_reason, ': ', 1), split_part(reject_reason, ': ', 2), count(*) FROM jd WHERE reject_reason IS NOT NULL GROUP BY ALL """
        + " ".join(f"UNION ALL SELECT 'optional_null', '{c}', '', count(*) FILTER ({c}0 IS NULL) FROM jd UNION ALL SELECT 'made_null', '{c}', '', count(*) FILTER ({c}0 IS NOT NULL AND {c} IS NULL) FROM jd" for c in ("csat", "nps", "days"))
        + " ".join(f" UNION ALL SELECT 'stray_spaces', '{c}', '', count(*) FILTER (trim({r}) <> {r}) FROM sheet UNION ALL SELECT 'written_null', '{c}', trim({r}), count(*) FROM sheet WHERE trim({r}) IN ({_tokens}) GROUP BY ALL" for c, r in _raw.items())
        + " ".join(f" UNION ALL SELECT 'decimal_comma', '{c}', '', count(*) FILTER (contains({_raw[c]}, ',')) FROM sheet" for c in ("productivity", "csat", "nps", "days"))
        + " UNION ALL SELECT 'period_shape', 'period', '', count(*) FILTER (NOT regexp_matches(trim(month_text), '^[0-9]{4}-[0-9]{2}$')) FROM sheet) WHERE rows > 0 OR kind IN ('rows_in', 'rejected')",
        "jd", extra=X,
    ),
    "sheet_repairs": with_tables(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) FILTER (trim({r}) <> {r}) AS stray_spaces, count(*) FILTER (trim({r}) IN ({_tokens})) AS written_nulls, coalesce(array_to_string(list_sort(list(DISTINCT trim({r})) FILTER (trim({r}) IN ({_tokens})))[1:4], '|'), '') AS examples, "
            f"count(*) FILTER ({'contains(' + r + ', chr(44))' if c in ('productivity', 'csat', 'nps', 'days') else 'false'}) AS decimal_commas, count(*) FILTER ({'NOT regexp_matches(trim(' + r + '), ' + chr(39) + '^[0-9]{4}-[0-9]{2}$' + chr(39) + ')' if c == 'period' else 'false'}) AS period_shapes FROM sheet"
            for c, r in _raw.items()
        ), "sheet",
    ),
    "sheet_orphans": with_tables("SELECT person, count(*) AS rows FROM jd WHERE reject_reason IS NULL AND person NOT IN (SELECT 'P' || lpad(person_id::VARCHAR, 5, '0') FROM directory WHERE person_id % 10 <> 0) GROUP BY 1", "jd", "directory", extra=X),
    "role_gaps": with_tables("SELECT DISTINCT family, country FROM directory WHERE (family, country) NOT IN (SELECT (family, country) FROM bands WHERE family <> 'BUILDING')", "directory", "bands"),
    "table_rows": with_tables(" UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS rows FROM {n}" for n in sorted(DEFINITIONS)), *sorted(DEFINITIONS)),
}
