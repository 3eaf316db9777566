"""Queries over the person-month table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import carried, profile
from ..operators import person_month as pm
from ..sources.tables import staged, work_folder
from ..sources.testbed import LAST_MONTH, MONTHS, staging
from .oracle import with_tables
from .store import kept

FACTS = ("metrics", "reviews", "first_reviews", "courses", "notes")


def built_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: staging(spark, sf_dir, n)
    return pm.person_months(t("directory"), t("exits"), t("bands"), *[t(n) for n in FACTS], LAST_MONTH, MONTHS)


def table_360(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The person-month table as kept by month: the first job that asks makes it (S4). The averages
    of cohorts are a small table of their own, joined on reading, so rows are written once."""
    rows = kept(spark, sf_dir, "person_months", built_months, dealt=True)
    return pm.with_cohorts(rows, kept(spark, sf_dir, "cohorts", lambda *_: pm.cohorts(rows)))


def latest(rows: DataFrame) -> int:
    """The last month of a table."""
    return rows.agg(F.max("idx")).first()[0]


def calendar(spark, sf_dir):
    """Months of the calendar with the people on the spine in each."""
    months = pm.calendar(spark, LAST_MONTH, MONTHS)
    rows = spine(spark, sf_dir).groupBy("idx").agg(F.count("*").alias("people"))
    again = pm.index_of_period(F.col("period")).alias("idx_again")
    return months.join(F.broadcast(rows), "idx", "left").select("idx", "period", "year", "month", "month_end", again, F.coalesce("people", F.lit(0)).alias("people"))


def spine(spark, sf_dir):
    return pm.spine(staging(spark, sf_dir, "directory"), staging(spark, sf_dir, "exits"), LAST_MONTH, MONTHS)


def metrics_month(spark, sf_dir):
    return pm.with_metrics(spine(spark, sf_dir), staging(spark, sf_dir, "metrics")).select(
        "person_id", "idx", "productivity", "csat", "prod_avg_3m", "prod_avg_3m_before", "prod_delta_3m", "prod_months_3m", "csat_avg_3m", "csat_delta_3m"
    )


def reviews_month(spark, sf_dir):
    out = pm.with_reviews(spine(spark, sf_dir), staging(spark, sf_dir, "reviews"), staging(spark, sf_dir, "first_reviews"))
    return out.select("person_id", "idx", "reviews_so_far", "score", "score_before", "score_delta", "months_since_review", "score_90")


def development_month(spark, sf_dir):
    out = pm.with_development(spine(spark, sf_dir), staging(spark, sf_dir, "courses"), staging(spark, sf_dir, "notes"))
    return out.select("person_id", "idx", "courses_12m", "hours_12m", "notes_6m", "n_notes", "months_since_course", "months_since_note")


COLUMNS_360 = (
    "person_id idx period name family country area hire_idx birth_year gender mode salary months_since_raise exit_idx regretted tenure age active leaves_soon productivity csat days_without_leave "
    "prod_avg_3m prod_avg_3m_before prod_delta_3m prod_months_3m csat_avg_3m csat_delta_3m reviews_so_far score score_before months_since_review score_delta score_90 n_notes courses_12m hours_12m "
    "notes_6m months_since_course months_since_note band_mid band_min band_max compa under_band age_band tenure_band courses_12m_cohort leave_cohort training_ratio leave_ratio"
).split()


def person_360(spark, sf_dir):
    return table_360(spark, sf_dir).select(*COLUMNS_360)


#: Months that are carried forward one by one, after those before them are made at once.
CARRIED = 6


def months_carried(spark, sf_dir):
    """The person-month table with its last months carried forward from the state of the month before."""
    path = f"{work_folder(spark)}/carried-{uuid.uuid4().hex}"
    facts = {n: staging(spark, sf_dir, n) for n in ("directory", "exits", "bands", *FACTS)}
    carried.start(path, facts, LAST_MONTH - CARRIED, MONTHS - CARRIED)
    for idx in range(LAST_MONTH - CARRIED + 1, LAST_MONTH + 1):
        carried.carry(spark, path, facts, idx)
    return carried.stored(spark, path).select(*COLUMNS_360)


def pay_view(spark, sf_dir):
    """One row for each active person at the latest month."""
    rows = table_360(spark, sf_dir)
    return rows.where((F.col("idx") == latest(rows)) & F.col("active")).select("person_id", "period", "area", "family", "country", "salary", "band_min", "band_mid", "band_max", "compa", "under_band")


def _mean(c: str):
    """Mean over ten-thousandths as integers: the same whatever order rows come in."""
    return F.sum(F.round(F.col(c) * 10000).cast("long")) / (10000.0 * F.nullif(F.count(c), F.lit(0).cast("long")))


def trend_by_area(spark, sf_dir):
    """Monthly averages of each area."""
    rows = table_360(spark, sf_dir).where("active")
    return rows.groupBy("period", "area").agg(
        F.count("*").alias("people"), *[_mean(c).alias(c) for c in ("productivity", "csat", "score", "compa")]
    )


def scale_totals(spark, sf_dir):
    """Rows, people, months, first and last period, active now, rows that rules look at."""
    rows = spine(spark, sf_dir)
    return rows.agg(
        F.count("*").alias("rows"), F.count_distinct("person_id").alias("people"), F.count_distinct("idx").alias("months"), F.min("period").alias("first_period"), F.max("period").alias("last_period"),
        F.sum(F.when(F.col("active") & (F.col("idx") == LAST_MONTH), 1).otherwise(0)).alias("active_now"), F.sum(F.when(F.col("active") & (F.col("tenure") >= 3), 1).otherwise(0)).alias("universe"),
    )


PROFILED = ("productivity", "csat", "score", "compa", "courses_12m", "months_since_note")
VALUED = ("family", "country", "age_band", "tenure_band", "gender")


def _last(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("idx") == latest(rows))


def column_profile(spark, sf_dir):
    """Per numeric column at the latest month: share of nulls, minimum, median, maximum, distinct values."""
    return profile.column_profile(_last(table_360(spark, sf_dir)), list(PROFILED))


def top_values(spark, sf_dir):
    """The three most frequent values of each text column at the latest month, with their share."""
    return profile.top_values(_last(table_360(spark, sf_dir)), list(VALUED))


def pay_quartiles(spark, sf_dir):
    """Exact quartiles of salary and of days without leave by role and country, over all months."""
    rows = table_360(spark, sf_dir)
    found = profile.quantiles(staged(profile.value_counts(rows, ["salary", "days_without_leave"], ["family", "country"])), [0.25, 0.5, 0.75], ["family", "country"])
    return found.withColumn("quantile", F.round("quantile", 6))


QUERIES = {
    "calendar": calendar, "spine": spine, "metrics_month": metrics_month, "reviews_month": reviews_month, "development_month": development_month, "person_360": person_360, "months_carried": months_carried,
    "pay_view": pay_view, "trend_by_area": trend_by_area, "scale_totals": scale_totals, "column_profile": column_profile, "top_values": top_values, "pay_quartiles": pay_quartiles,
}

_profile = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(100 * avg(({c} IS NULL)::INT), 4) AS null_pct, min({c})::DOUBLE AS least, round(median({c}), 6) AS median, max({c})::DOUBLE AS most, count(DISTINCT {c}) AS \"distinct\" FROM l"
    for c in PROFILED
)
_values = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value FROM p360 WHERE idx = {LAST_MONTH}" for c in VALUED)
SQL = {
    "calendar": with_tables(
        f"""SELECT idx, printf('%04d-%02d', idx // 12, idx % 12 + 1) AS period, (idx // 12)::INT AS year, (idx % 12 + 1)::INT AS month, last_day(make_date((idx // 12)::INT, (idx % 12 + 1)::INT, 1)) AS month_end,
          idx AS idx_again, coalesce(people, 0) AS people FROM (SELECT unnest(range({LAST_MONTH - MONTHS + 1}, {LAST_MONTH + 1})) AS idx) LEFT JOIN (SELECT idx, count(*) AS people FROM spine GROUP BY 1) USING (idx)""",
        "spine",
    ),
    "spine": with_tables("SELECT * FROM spine", "spine"),
    "metrics_month": with_tables("SELECT person_id, idx, productivity, csat, prod_avg_3m, prod_avg_3m_before, prod_delta_3m, prod_months_3m, csat_avg_3m, csat_delta_3m FROM op_month", "op_month"),
    "reviews_month": with_tables("SELECT person_id, idx, reviews_so_far, score, score_before, score_delta, months_since_review, score_90 FROM review_month", "review_month"),
    "development_month": with_tables("SELECT person_id, idx, courses_12m, hours_12m, notes_6m, n_notes, months_since_course, months_since_note FROM dev_month", "dev_month"),
    "person_360": with_tables(f"SELECT {', '.join(COLUMNS_360)} FROM p360", "p360"),
    "months_carried": with_tables(f"SELECT {', '.join(COLUMNS_360)} FROM p360", "p360"),
    "pay_view": with_tables("SELECT person_id, period, area, family, country, salary, band_min, band_mid, band_max, compa, under_band FROM p360 WHERE active AND idx = (SELECT max(idx) FROM p360)", "p360"),
    "trend_by_area": with_tables(
        "SELECT period, area, count(*) AS people, " + ", ".join(f"sum(round({c} * 10000)::BIGINT) / (10000.0::DOUBLE * nullif(count({c}), 0)) AS {c}" for c in ("productivity", "csat", "score", "compa")) + " FROM p360 WHERE active GROUP BY ALL",
        "p360",
    ),
    "scale_totals": with_tables(
        f"""SELECT count(*) AS rows, count(DISTINCT person_id) AS people, count(DISTINCT idx) AS months, min(period) AS first_period, max(period) AS last_period,
          count(*) FILTER (active AND idx = {LAST_MONTH}) AS active_now, count(*) FILTER (active AND tenure >= 3) AS universe FROM spine""",
        "spine",
    ),
    "column_profile": with_tables(_profile, "p360", "l", extra={"l": (("p360",), f"SELECT * FROM p360 WHERE idx = {LAST_MONTH}")}),
    "pay_quartiles": with_tables(
        "SELECT family, country, \"column\", q, round(quantile, 6) AS quantile FROM (SELECT family, country, \"column\", unnest([0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE]) AS q, unnest(quantile_cont(value, [0.25, 0.5, 0.75])) AS quantile "
        "FROM (SELECT family, country, unnest(['salary', 'days_without_leave']) AS \"column\", unnest([salary::DOUBLE, days_without_leave::DOUBLE]) AS value FROM p360) WHERE value IS NOT NULL GROUP BY family, country, \"column\")",
        "p360",
    ),
    "top_values": with_tables(
        f"""SELECT * FROM (SELECT "column", value, n, round(n / sum(n) OVER (PARTITION BY "column"), 6) AS share, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank
          FROM (SELECT "column", value, count(*) AS n FROM ({_values}) GROUP BY ALL)) WHERE rank <= 3""",
        "p360",
    ),
}
