"""People tables derived from the sales tables of the test data.

Each definition is plain SQL that Spark and DuckDB read alike, so the oracle of a query starts
from the same staging tables. Sizes follow the sales tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Last month of the calendar and its length; a month is year * 12 + month - 1.
LAST_MONTH = 24019
MONTHS = 48

_month = "CAST(year({c}) * 12 + month({c}) - 1 AS BIGINT)"

#: Staging table -> (sales tables that it reads, SQL with their names in braces).
DEFINITIONS: dict[str, tuple[tuple[str, ...], str]] = {
    "directory": (
        ("customer", "nation", "region"),
        f"""SELECT c_custkey AS person_id, c_name AS name, c_mktsegment AS family, r_name AS country, n_name AS area,
          CAST({LAST_MONTH} - (c_custkey * 37) % 72 AS BIGINT) AS hire_idx, CAST(1950 + (c_custkey * 7) % 52 AS BIGINT) AS birth_year,
          CASE c_custkey % 2 WHEN 0 THEN 'F' ELSE 'M' END AS gender, CASE c_custkey % 7 WHEN 0 THEN 'remote' WHEN 1 THEN 'mixed' ELSE 'office' END AS mode,
          c_acctbal + 2000 AS salary, CAST((c_custkey * 11) % 36 AS BIGINT) AS months_since_raise
        FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey""",
    ),
    "exits": (
        ("customer",),
        f"""SELECT c_custkey AS person_id, CAST({LAST_MONTH} - (c_custkey * 13) % 24 AS BIGINT) AS exit_idx, c_acctbal >= 3000 AS regretted
        FROM {{customer}} WHERE c_custkey % 5 = 0 AND (c_custkey * 13) % 24 < (c_custkey * 37) % 72""",
    ),
    "bands": (
        ("customer", "nation", "region"),
        """SELECT family, country, mid AS band_mid, round(mid * 0.8, 2) AS band_min, round(mid * 1.25, 2) AS band_max
        FROM (SELECT c_mktsegment AS family, r_name AS country, round(avg(c_acctbal + 2000), 2) AS mid
          FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY c_mktsegment, r_name) b""",
    ),
    "metrics": (
        ("lineitem", "orders"),
        f"""SELECT person_id, idx, 50 + floor(20 * q / n) / 10 AS productivity, CASE WHEN person_id % 2 = 0 THEN 1 + floor(40 * d / n) / 100 END AS csat,
          CAST((n * 131 + person_id * 17) % 1000 AS BIGINT) AS days_without_leave
        FROM (SELECT o_custkey AS person_id, {_month.format(c="l_shipdate")} AS idx, sum(l_quantity) AS q, sum(CAST(round(l_discount * 100) AS BIGINT)) AS d, count(*) AS n
          FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey GROUP BY 1, 2) m""",
    ),
    "reviews": (
        ("orders",),
        f"""SELECT o_custkey AS person_id, o_orderkey AS cycle, {_month.format(c="o_orderdate")} AS idx, 1 + floor(300 * least(o_totalprice, 500000) / 500000) / 100 AS score
        FROM {{orders}} WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""",
    ),
    "first_reviews": (
        ("customer",),
        f"""SELECT c_custkey AS person_id, CAST({LAST_MONTH} - (c_custkey * 37) % 72 + 3 AS BIGINT) AS idx_90, 1 + floor(300 * (c_acctbal + 1000) / 11000) / 100 AS score_90
        FROM {{customer}} WHERE c_custkey % 3 <> 0""",
    ),
    "courses": (
        ("lineitem", "orders"),
        f"""SELECT o_custkey AS person_id, {_month.format(c="l_shipdate")} AS idx, l_partkey AS course, CAST(2 * l_linenumber AS BIGINT) AS hours
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'""",
    ),
    "notes": (
        ("documents", "customer"),
        f"""SELECT doc_id AS note_id, doc_id % n + 1 AS person_id, CAST({LAST_MONTH} - (doc_id * 7) % 24 AS BIGINT) AS idx, source AS author, text
        FROM {{documents}} CROSS JOIN (SELECT count(*) AS n FROM {{customer}}) c""",
    ),
}

#: The metrics as a hand-kept sheet: three spellings of the month, decimal commas, stray spaces,
#: written nulls, cells out of range, illegible months and repeated rows, all by remainders.
_cells = """person_id * 100000 + idx AS _row,
  CASE WHEN person_id % 11 = 0 THEN ' ' ELSE '' END || CASE WHEN person_id % 211 = 0 THEN 'X1' ELSE 'P' || lpad(CAST(person_id AS STRING), 5, '0') END || CASE WHEN person_id % 13 = 0 THEN ' ' ELSE '' END AS person_code,
  CASE WHEN (person_id + idx) % 97 = 0 THEN '2026-13' WHEN (person_id + idx) % 3 = 0 THEN yy || '-' || lpad(CAST(mm AS STRING), 2, '0')
    WHEN (person_id + idx) % 3 = 1 THEN substr('enefebmarabrmayjunjulagosepoctnovdic', 3 * mm - 2, 3) || '-' || yy ELSE CAST(mm AS STRING) || '/' || yy END AS month_text,
  CASE WHEN (person_id * 3 + idx) % 41 = 0 THEN '999' WHEN (person_id * 3 + idx) % 43 = 0 THEN 'N/A' WHEN person_id % 2 = 0 THEN replace(CAST(productivity AS STRING), '.', ',') ELSE CAST(productivity AS STRING) || '%' END AS prod_text,
  CASE WHEN (person_id + idx * 7) % 29 = 0 THEN '0' WHEN csat IS NULL THEN 's/i' ELSE CAST(csat AS STRING) END AS csat_text,
  CASE WHEN (person_id + idx) % 5 = 0 THEN '2.5' WHEN (person_id + idx) % 17 = 0 THEN '-' ELSE CAST((person_id + idx) % 100 AS STRING) END AS nps_text,
  CASE WHEN (person_id + idx) % 19 = 0 THEN '--' ELSE CAST(days_without_leave AS STRING) END AS days_text"""
_dated = "SELECT m.*, CAST(CAST(floor(idx / 12) AS INT) AS STRING) AS yy, CAST(idx % 12 + 1 AS INT) AS mm FROM ({m}) m"
DEFINITIONS["sheet"] = (
    ("lineitem", "orders"),
    f"""SELECT * FROM (SELECT {_cells} FROM ({_dated.format(m=DEFINITIONS["metrics"][1])}) x) a
    UNION ALL SELECT _row + 50000 AS _row, person_code, month_text, prod_text, csat_text, nps_text, days_text FROM (SELECT {_cells} FROM ({_dated.format(m=DEFINITIONS["metrics"][1])}) y) b WHERE _row % 31 = 0""",
)
DEFINITIONS["made_readings"] = (
    ("documents", "customer"),
    """SELECT note_id, person_id, idx, CASE WHEN note_id % 6 = 1 THEN 'P' || lpad(CAST(note_id % 100000 AS STRING), 5, '0') || ' wrote: ' || text ELSE text END AS text, CASE note_id % 5 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' WHEN 2 THEN 'positive' WHEN 3 THEN 'insufficient' ELSE CASE WHEN note_id % 3 = 0 THEN 'angry' ELSE 'negative' END END AS tone,
      CASE note_id % 4 WHEN 0 THEN 'load' WHEN 1 THEN 'pay' WHEN 2 THEN 'weather' ELSE 'team' END AS topic, CASE note_id % 7 WHEN 0 THEN 'growth' WHEN 1 THEN 'load' ELSE '' END AS signal,
      CASE WHEN note_id % 9 = 0 THEN 'never said' WHEN note_id % 6 = 1 THEN '[ID] wrote: ' ELSE substr(text, 1, 20) END AS quote, CASE WHEN note_id % 10 = 0 THEN 1.2 ELSE 0.8 END AS confidence
    FROM (""" + DEFINITIONS["notes"][1] + ") n",
)


#: What sort of customer a person stands for; no rule may read it.
DEFINITIONS["profiles"] = (
    ("customer",),
    """SELECT c_custkey AS person_id, CASE WHEN c_acctbal < 0 THEN 'in debt' WHEN c_acctbal < 3000 THEN 'careful' WHEN c_custkey % 3 = 0 THEN 'restless' ELSE 'settled' END AS profile
    FROM {customer}""",
)


#: Visits as people write them down: dates in five forms, two that are none, and yes or no in many words.
_visit = "CAST(year(o_orderdate) AS STRING) AS yy, CAST(month(o_orderdate) AS STRING) AS mm, CAST(day(o_orderdate) AS STRING) AS dd"
DEFINITIONS["visits"] = (
    ("orders",),
    f"""SELECT _row, who, CASE _row % 7 WHEN 0 THEN yy || '-' || mm || '-' || dd WHEN 1 THEN dd || '/' || mm || '/' || yy WHEN 2 THEN dd || '-' || mm || '-' || yy WHEN 3 THEN yy || '/' || mm || '/' || dd
        WHEN 4 THEN yy || '-' || mm || '-' || dd || ' 7:05:09' WHEN 5 THEN '31/02/' || yy ELSE dd || '/' || mm || '/' || substr(yy, 3, 2) END AS day_text,
      CASE _row % 9 WHEN 0 THEN 'SI' WHEN 1 THEN 'sí' WHEN 2 THEN ' Yes ' WHEN 3 THEN '1' WHEN 4 THEN 'true' WHEN 5 THEN 'Verdadero' WHEN 6 THEN 'no' WHEN 7 THEN 'N/A' ELSE 'maybe' END AS kept_text
    FROM (SELECT o_orderkey AS _row, 'P' || lpad(CAST(o_custkey AS STRING), 5, '0') AS who, {_visit} FROM {{orders}}) v""",
)


def staging(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, sql = DEFINITIONS[name]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def staging_sql(name: str) -> str:
    """The definition as a common table expression over the registered views."""
    tables, sql = DEFINITIONS[name]
    return f"{name} AS ({sql.format(**{t: t for t in tables})})"
