"""The person-month table carried forward: a run reads one month's facts and what is known of each
person up to the month before, and replaces that month of a stored table.

The state has one row for each person who is, or may come to be, on the spine: the last months of
what windows look at (eleven at most), the months of the last course and note, and the review in
force. It is kept by month, so a month can be run again and gives the same rows. A person's state
goes when they leave; reviews from before the first month on the spine are in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import tables
from ..sources.tables import staged
from . import person_month as pm

Facts = dict[str, DataFrame]
#: Months before the current one that windows look at.
RECENT = {"productivity": 5, "csat": 5, "n_courses": 11, "n_hours": 11, "n_notes": 5}
REVIEW = ("reviews_so_far", "score", "score_before", "review_at")
SINCE = {"last_course": "n_courses", "last_note": "n_notes"}


def _by_month(facts: Facts, last: int, months: int) -> DataFrame:
    return pm.facts_by_month(*[facts[n] for n in ("directory", "exits", "metrics", "reviews", "courses", "notes")], last, months)


def state_at(facts: Facts, last: int, months: int) -> DataFrame:
    """The state after month ``last``, from the facts of all months of a calendar of ``months``."""
    rows = _by_month({**facts, "reviews": facts["reviews"].where(F.col("idx") <= last)}, last, months)
    on, most = F.col("on"), max(RECENT.values())
    seen = rows.groupBy("person_id").agg(
        F.sort_array(F.collect_list(F.when(on & (F.col("idx") > last - most), F.struct("idx", *RECENT)))).alias("seen"), F.max(F.when(on, F.col("idx"))).alias("at"),
        *[F.max(F.when(on & (F.col(n) > 0), F.col("idx"))).alias(c) for c, n in SINCE.items()],
        F.max(F.when(F.col("review_no").isNotNull(), F.struct("review_no", "score", "score_before", "idx"))).alias("r"), F.sum("reviews").alias("reviews_so_far"),
    )
    # Who came and has left is not carried on; who has not come yet is if there are reviews.
    out = seen.where(F.when(F.col("at").isNull(), F.col("r").isNotNull()).otherwise(F.col("at") == last))
    recent = [F.when(F.col("at").isNotNull(), F.slice(f"seen.{c}", F.greatest(F.size("seen") - n + 1, F.lit(1)), n)).alias(f"past_{c}") for c, n in RECENT.items()]
    known = [F.col("r.score").alias("score"), F.col("r.score_before").alias("score_before"), F.col("r.idx").alias("review_at")]
    return out.select("person_id", F.col("at").isNotNull().alias("entered"), *recent, *SINCE, "reviews_so_far", *known)


def _reviewed(idx: int) -> dict[str, Column]:
    """The review in force after month ``idx``, from the state and the month's own reviews (``own_``)."""
    new = F.coalesce(F.col("own_reviews") > 0, F.lit(False))
    before = F.when(F.col("own_reviews") > 1, F.col("own_score_before")).otherwise(F.col("score"))
    return {
        "reviews_so_far": F.coalesce("reviews_so_far", F.lit(0).cast("long")) + F.coalesce("own_reviews", F.lit(0).cast("long")),
        "score": F.when(new, F.col("own_score")).otherwise(F.col("score")), "score_before": F.when(new, before).otherwise(F.col("score_before")),
        "review_at": F.when(new, F.lit(idx).cast("long")).otherwise(F.col("review_at")),
    }


def _mean(values: Column, first: int, n: int) -> Column:
    """The mean of known values among ``n``, the last of them ``first`` places from the end."""
    end = F.size(values) - first
    window = F.when(end > 0, F.slice(values, F.greatest(end - n + 1, F.lit(1)), F.least(end, F.lit(n)))).otherwise(F.slice(values, 1, 0))
    known = F.filter(window, lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known).cast("double"))


def month(state: DataFrame, facts: Facts, idx: int) -> tuple[DataFrame, DataFrame]:
    """(rows of the person-month table of month ``idx``, the state after it)."""
    own = {n: df.where(F.col("idx") == idx) if n in ("metrics", "reviews", "courses", "notes") else df for n, df in facts.items()}
    here = _by_month(own, idx, 1).drop("review_no").withColumnsRenamed({c: f"own_{c}" for c in ("score", "score_before", "reviews")})
    every = state.join(here, "person_id", "full").withColumn("on", F.coalesce("on", F.lit(False))).withColumn("idx", F.lit(idx).cast("long"))
    on, past = F.col("on"), lambda c: F.coalesce(f"past_{c}", F.array().cast(T.ArrayType(here.schema[c].dataType)))
    every = every.where(on | F.col("entered").isNotNull() | (F.col("own_reviews") > 0)).withColumns(_reviewed(idx))
    every = every.withColumns({f"past_{c}": F.when(on, F.array_append(past(c), F.col(c))).otherwise(past(c)) for c in RECENT})
    every = staged(every.withColumns({c: F.when(on & (F.col(n) > 0), F.col("idx")).otherwise(F.col(c)) for c, n in SINCE.items()}))
    # Who was on the spine and is no more has left.
    kept = every.where(on | ~F.coalesce("entered", F.lit(False)))
    after = kept.select(
        "person_id", on.alias("entered"), *[F.slice(f"past_{c}", F.greatest(F.size(f"past_{c}") - n + 1, F.lit(1)), n).alias(f"past_{c}") for c, n in RECENT.items()], *SINCE, *REVIEW
    )
    now, before = (lambda c: _mean(F.col(f"past_{c}"), 0, 3)), (lambda c: _mean(F.col(f"past_{c}"), 3, 3))
    delta = lambda c: F.round(now(c) - before(c), 6) + F.lit(0.0)
    total = lambda c: F.aggregate(f"past_{c}", F.lit(0).cast("long"), lambda a, x: a + x)
    rows = every.where(on).withColumns({
        "prod_avg_3m": F.round(now("productivity"), 6), "prod_avg_3m_before": F.round(before("productivity"), 6), "prod_delta_3m": delta("productivity"),
        "prod_months_3m": F.size(F.filter(F.slice("past_productivity", F.greatest(F.size("past_productivity") - 2, F.lit(1)), 3), lambda x: x.isNotNull())).cast("long"),
        "csat_avg_3m": F.round(now("csat"), 6), "csat_delta_3m": delta("csat"),
        "months_since_review": F.col("idx") - F.col("review_at"),
        "courses_12m": total("n_courses"), "hours_12m": total("n_hours"), "notes_6m": total("n_notes"),
        "months_since_course": F.col("idx") - F.col("last_course"), "months_since_note": F.col("idx") - F.col("last_note"),
    })
    rows = rows.drop("on", "n_courses", "n_hours", "own_score", "own_score_before", "own_reviews", "review_at", "entered", *SINCE, *[f"past_{c}" for c in RECENT])
    rows = staged(pm.with_people(rows, facts["directory"], facts["exits"], facts["bands"], facts["first_reviews"]))
    return pm.with_cohorts(rows, pm.cohorts(rows)), after


def start(path: str, facts: Facts, last: int, months: int) -> None:
    """A stored table of the ``months`` months up to ``last``, made at once, and its state."""
    rows = pm.person_360(*[facts[n] for n in ("directory", "exits", "bands", "metrics", "reviews", "first_reviews", "courses", "notes")], last, months)
    tables.replace(rows, f"{path}/rows", "idx")
    tables.replace(state_at(facts, last, months).withColumn("idx", F.lit(last).cast("long")), f"{path}/state", "idx")


def carry(spark: SparkSession, path: str, facts: Facts, idx: int) -> None:
    """Month ``idx`` from its facts and the state of the month before: replaces the month's rows
    and state, and reads no other month."""
    state = spark.read.parquet(f"{path}/state").where(F.col("idx") == idx - 1).drop("idx")
    if not state.take(1):
        raise ValueError(f"no state of month {idx - 1} in {path}")
    rows, after = month(state, facts, idx)
    tables.replace(rows, f"{path}/rows", "idx")
    tables.replace(after.withColumn("idx", F.lit(idx).cast("long")), f"{path}/state", "idx")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All months of the stored table; months are partitions, so a filter on idx reads only those."""
    rows = spark.read.parquet(f"{path}/rows")
    return rows.withColumn("idx", F.col("idx").cast("long"))
