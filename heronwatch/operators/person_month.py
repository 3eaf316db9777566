"""The point-in-time table: one row for each person and month, with what was known then.

The spine is made by exploding each person's own months, never by a cross join. Windows run over
(person, month) only, so a partition has no more rows than the calendar has months. Cohort averages
are an aggregate joined back, since as a window they would put a quarter of a month's people in one
partition. The whole table is made with one exchange: monthly facts are dealt out by person as narrow
rows, months are made where they are, and what is known of a person is joined last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import staged


def month_index(day: Column) -> Column:
    return (F.year(day) * 12 + F.month(day) - 1).cast("long")


def index_of_period(period: Column) -> Column:
    """Month index of 'YYYY-MM'."""
    return (F.substring(period, 1, 4).cast("long") * 12 + F.substring(period, 6, 2).cast("long") - 1).cast("long")


def period_of_index(idx: Column) -> Column:
    return F.format_string("%04d-%02d", F.floor(idx / 12).cast("long"), (idx % 12 + 1).cast("long"))


def calendar(spark, last: int, months: int) -> DataFrame:
    """idx, period, year, month, month_end of the ``months`` months up to ``last``."""
    rows = spark.range(last - months + 1, last + 1).withColumnRenamed("id", "idx")
    year, month = F.floor(F.col("idx") / 12).cast("int"), (F.col("idx") % 12 + 1).cast("int")
    return rows.select("idx", period_of_index(F.col("idx")).alias("period"), year.alias("year"), month.alias("month"), F.last_day(F.make_date(year, month, F.lit(1))).alias("month_end"))


def spine(directory: DataFrame, exits: DataFrame, last: int, months: int, ahead: int = 3) -> DataFrame:
    """Person x month from hire (or the calendar's start) to exit (or its end).

    The exit month stays, not active. ``leaves_soon`` is the forward label, for evaluation only.
    """
    rows = _spans(directory.join(exits, "person_id", "left"), last, months).withColumn("idx", F.explode(F.sequence("_a", "_b")))
    return rows.drop("_a", "_b").withColumns(_standing(ahead))


def _spans(people: DataFrame, last: int, months: int) -> DataFrame:
    """People with a month in the calendar, with their first (``_a``) and last (``_b``) one."""
    start, stop = F.greatest("hire_idx", F.lit(last - months + 1)), F.least(F.coalesce("exit_idx", F.lit(last)), F.lit(last))
    return people.withColumn("_a", start).withColumn("_b", stop).where("_a <= _b")


def _standing(ahead: int = 3) -> dict[str, Column]:
    """What a month tells of a person by their dates."""
    gap = F.col("exit_idx") - F.col("idx")
    return {
        "period": period_of_index(F.col("idx")),
        "tenure": F.col("idx") - F.col("hire_idx"),
        "age": F.floor(F.col("idx") / 12) - F.col("birth_year"),
        "active": F.coalesce(gap > 0, F.lit(True)),
        "leaves_soon": F.coalesce(gap.between(1, ahead), F.lit(False)),
    }


def _last_rows(n: int, skip: int = 0) -> Window:
    return Window.partitionBy("person_id").orderBy("idx").rowsBetween(-(n + skip - 1), -skip)


def with_metrics(rows: DataFrame, metrics: DataFrame) -> DataFrame:
    """Monthly metrics with 3-month averages, the averages before those, and the deltas."""
    return rows.join(metrics, ["person_id", "idx"], "left").withColumns(_trends())


def _trends() -> dict[str, Column]:
    now, before = _last_rows(3), _last_rows(3, 3)
    trend = lambda c: F.round(F.avg(c).over(now) - F.avg(c).over(before), 6) + F.lit(0.0)  # noqa: E731  (no nought below nought)
    return {
        "prod_avg_3m": F.round(F.avg("productivity").over(now), 6),
        "prod_avg_3m_before": F.round(F.avg("productivity").over(before), 6),
        "prod_delta_3m": trend("productivity"),
        "prod_months_3m": F.sum(F.when(F.col("productivity").isNotNull(), 1).otherwise(0)).over(now),
        "csat_avg_3m": F.round(F.avg("csat").over(now), 6),
        "csat_delta_3m": trend("csat"),
    }


def review_history(reviews: DataFrame) -> DataFrame:
    """The last review of each person and month, with its rank and the score before it."""
    w = Window.partitionBy("person_id").orderBy("idx", "cycle")
    ranked = reviews.withColumns({"review_no": F.row_number().over(w), "score_before": F.lag("score").over(w)})
    last = ranked.groupBy("person_id", "idx").agg(F.max(F.struct("review_no", "score", "score_before", F.col("idx").alias("at"))).alias("review"), F.count("*").alias("reviews"))
    return last


def with_reviews(rows: DataFrame, reviews: DataFrame, first_reviews: DataFrame) -> DataFrame:
    """The review in force each month (the last one up to it, even from before the calendar),
    the score before it, their difference; the 90-day review once it has happened."""
    history = review_history(reviews)
    # Reviews in months that are not on the spine (before the calendar) still count: both are
    # put in one order and the last review seen is carried on.
    marks = rows.select("person_id", "idx").withColumn("_spine", F.lit(True)).join(history, ["person_id", "idx"], "full")
    w = Window.partitionBy("person_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    known = marks.withColumns({"r": F.last("review", ignorenulls=True).over(w), "reviews_so_far": F.sum(F.coalesce("reviews", F.lit(0))).over(w)}).where("_spine")
    known = known.select("person_id", "idx", "reviews_so_far", F.col("r.score").alias("score"), F.col("r.score_before").alias("score_before"), (F.col("idx") - F.col("r.at")).alias("months_since_review"))
    out = rows.join(known, ["person_id", "idx"]).join(first_reviews, "person_id", "left")
    return out.withColumns(_judged()).drop("idx_90")


def _judged() -> dict[str, Column]:
    return {"score_delta": F.round(F.col("score") - F.col("score_before"), 6), "score_90": F.when(F.col("idx_90") <= F.col("idx"), F.col("score_90"))}


def with_development(rows: DataFrame, courses: DataFrame, notes: DataFrame) -> DataFrame:
    """Courses and hours over 12 months, notes over 6, months since the last of each."""
    taken = courses.groupBy("person_id", "idx").agg(F.count("*").alias("n_courses"), F.sum("hours").alias("n_hours"))
    heard = notes.groupBy("person_id", "idx").agg(F.count("*").alias("n_notes"))
    out = rows.join(taken, ["person_id", "idx"], "left").join(heard, ["person_id", "idx"], "left").na.fill(0, ["n_courses", "n_hours", "n_notes"])
    return out.withColumns(_development()).drop("n_courses", "n_hours")


def _development() -> dict[str, Column]:
    year, half = _last_rows(12), _last_rows(6)
    ever = Window.partitionBy("person_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    since = lambda c: F.col("idx") - F.last(F.when(F.col(c) > 0, F.col("idx")), ignorenulls=True).over(ever)
    return {
        "courses_12m": F.sum("n_courses").over(year), "hours_12m": F.sum("n_hours").over(year), "notes_6m": F.sum("n_notes").over(half),
        "months_since_course": since("n_courses"), "months_since_note": since("n_notes"),
    }


def tenure_band(tenure: Column) -> Column:
    return F.when(tenure < 12, "0-11").when(tenure < 24, "12-23").when(tenure < 48, "24-47").otherwise("48+")


def age_band(age: Column) -> Column:
    return F.when(age < 26, "<26").when(age < 36, "26-35").when(age < 46, "36-45").otherwise("46+")


def with_bands(rows: DataFrame, bands: DataFrame) -> DataFrame:
    """Salary band of the role and country; ``under_band`` is false where it is not known."""
    out = rows.join(bands, ["family", "country"], "left")
    return out.withColumns({"compa": F.round(F.try_divide("salary", "band_mid"), 4), "under_band": F.coalesce(F.col("salary") < F.col("band_min"), F.lit(False))})


def _bands_of_month() -> dict[str, Column]:
    return {"age_band": age_band(F.col("age")), "tenure_band": tenure_band(F.col("tenure"))}


def cohorts(rows: DataFrame) -> DataFrame:
    """Averages of each month's tenure cohorts: four rows a month."""
    return rows.groupBy("idx", "tenure_band").agg(F.avg("courses_12m").alias("courses_12m_cohort"), F.avg("days_without_leave").alias("leave_cohort"))


def with_cohorts(rows: DataFrame, averages: DataFrame) -> DataFrame:
    """The averages of the person's cohort (as ``cohorts`` gives them) and the ratio to them."""
    out = rows.join(F.broadcast(averages), ["idx", "tenure_band"])
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.nullif(F.col(b), F.lit(0.0)))
    return out.withColumns({"training_ratio": F.round(ratio("courses_12m", "courses_12m_cohort"), 6), "leave_ratio": F.round(ratio("days_without_leave", "leave_cohort"), 6)}).withColumns(
        {"courses_12m_cohort": F.round("courses_12m_cohort", 6), "leave_cohort": F.round("leave_cohort", 6)}
    )


#: Columns of a month's facts that only count on the spine.
VALUES, COUNTS = ("productivity", "csat", "days_without_leave"), ("n_courses", "n_hours", "n_notes")


def facts_by_month(directory, exits, metrics, reviews, courses, notes, last: int, months: int) -> DataFrame:
    """One row for each person and month with anything known: ``on`` the spine or not, the values
    and counts of the month (null and 0 off the spine), and its last review as in ``review_history``.

    The rows of a person lie in one task, so windows over a person and joins by person alone go on
    without another exchange. Metrics have one row for each person and month.
    """
    spans = _spans(directory.select("person_id", "hire_idx").join(exits.select("person_id", "exit_idx"), "person_id", "left"), last, months).select("person_id", "_a", "_b")
    one = F.lit(1).cast("long")
    history = review_history(reviews).select("person_id", "idx", "review.review_no", "review.score", "review.score_before", "reviews")
    facts = [metrics.select("person_id", "idx", *VALUES), history, courses.select("person_id", "idx", one.alias("n_courses"), F.col("hours").alias("n_hours")), notes.select("person_id", "idx", one.alias("n_notes"))]
    for fact in facts:
        spans = spans.unionByName(fact, allowMissingColumns=True)
    of_row = F.when(F.col("_a").isNull(), F.array("idx")).otherwise(F.sequence("_a", "_b"))
    each = spans.repartition("person_id").withColumn("idx", F.explode(of_row))
    rows = each.groupBy("person_id", "idx").agg(
        (F.count("_a") > 0).alias("on"), *[F.max(c).alias(c) for c in (*VALUES, "review_no", "score", "score_before", "reviews")], *[F.sum(c).alias(c) for c in COUNTS]
    )
    return rows.withColumns({**{c: F.when(F.col("on"), F.col(c)) for c in VALUES}, **{c: F.when(F.col("on") & F.col(c).isNotNull(), F.col(c)).otherwise(0) for c in COUNTS}})


def with_people(rows: DataFrame, directory: DataFrame, exits: DataFrame, bands: DataFrame, first_reviews: DataFrame) -> DataFrame:
    """Rows of ``person_id`` and ``idx`` with all that is known of the person."""
    people = with_bands(directory.join(exits, "person_id", "left"), bands).join(first_reviews, "person_id", "left")
    return rows.join(people, "person_id").withColumns(_standing()).withColumns(_bands_of_month() | _judged()).drop("idx_90")


def person_months(directory, exits, bands, metrics, reviews, first_reviews, courses, notes, last: int, months: int) -> DataFrame:
    """The person-month table without the averages of cohorts. What ``with_metrics``, ``with_reviews``
    and ``with_development`` add, in one window: facts off the spine are null or 0 and change nothing,
    and reviews off the spine (from before the calendar) still count."""
    rows = facts_by_month(directory, exits, metrics, reviews, courses, notes, last, months)
    ever = Window.partitionBy("person_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    review = F.when(F.col("review_no").isNotNull(), F.struct("review_no", "score", "score_before", F.col("idx").alias("at")))
    seen = rows.withColumns({**_trends(), **_development(), "r": F.last(review, ignorenulls=True).over(ever), "reviews_so_far": F.sum(F.coalesce("reviews", F.lit(0))).over(ever)}).where("on")
    seen = seen.withColumns({"score": F.col("r.score"), "score_before": F.col("r.score_before"), "months_since_review": F.col("idx") - F.col("r.at")})
    return with_people(seen.drop("on", "r", "review_no", "reviews", "n_courses", "n_hours"), directory, exits, bands, first_reviews)


def person_360(directory, exits, bands, metrics, reviews, first_reviews, courses, notes, last: int, months: int) -> DataFrame:
    """The whole table. Rows are written before the cohort averages, which read them twice: windows
    are worked out once, and the plan stays small."""
    rows = staged(person_months(directory, exits, bands, metrics, reviews, first_reviews, courses, notes, last, months))
    return with_cohorts(rows, cohorts(rows))
