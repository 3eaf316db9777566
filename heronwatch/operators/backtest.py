"""Do the alerts come before the exits? Right-censored measures of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranking, rules

WINDOW = 6


def observed_exits(rows: DataFrame) -> DataFrame:
    """First inactive month of each person who left, and whether that was regretted."""
    return rows.where("exit_idx IS NOT NULL AND NOT active").groupBy("person_id").agg(F.min("idx").alias("left_idx"), F.bool_or("regretted").alias("left_regretted"))


def labelled(rows: DataFrame, exits: DataFrame, universe: str, window: int = WINDOW) -> DataFrame:
    """The universe with its outcome: leaves, or leaves regretted, within the window."""
    out = rows.where(universe).join(exits, "person_id", "left")
    leaves = F.coalesce((F.col("left_idx") - F.col("idx")).between(1, window), F.lit(False))
    return out.withColumns({"leaves": leaves, "leaves_regretted": leaves & F.coalesce("left_regretted", F.lit(False))})


def last_observed(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row: the last month whose whole window has been seen."""
    return rows.agg((F.max("idx") - window).alias("cut"))


def share(condition: Column) -> Column:
    """Share of rows where the condition holds, from whole counts."""
    return F.try_divide(F.sum(F.when(condition, 1).otherwise(0)).cast("double"), F.count("*").cast("double"))


def base_rates(universe: DataFrame, cut: DataFrame) -> DataFrame:
    return universe.join(F.broadcast(cut), F.col("idx") <= F.col("cut")).agg(F.count("*").alias("rows"), share(F.col("leaves")).alias("base_any"), share(F.col("leaves_regretted")).alias("base_regretted"))


def precision(alerts: DataFrame, universe: DataFrame, cut: DataFrame, *by: str) -> DataFrame:
    """Of the alerts with a whole window, the share followed by an exit; alerts a month."""
    seen = alerts.join(universe.select("person_id", "idx", "leaves", "leaves_regretted"), ["person_id", "idx"]).join(F.broadcast(cut), F.col("idx") <= F.col("cut"))
    return seen.groupBy(*by).agg(F.count("*").alias("alerts"), share(F.col("leaves")).alias("precision_any"), share(F.col("leaves_regretted")).alias("precision_regretted"))


def coverage(alerts: DataFrame, exits: DataFrame, by: list[str], groups: DataFrame, window: int = WINDOW) -> DataFrame:
    """Regretted exits with an alert in the months before, for each group of ``groups``."""
    lost = exits.where("left_regretted").select("person_id", "left_idx")
    hit = lost.join(alerts.select("person_id", "idx", *by), "person_id").where((F.col("idx") >= F.col("left_idx") - window) & (F.col("idx") < F.col("left_idx")))
    n = lost.agg(F.count("*").alias("exits"))
    found = hit.groupBy(*by).agg(F.count_distinct("person_id").alias("covered"))
    out = groups.join(found, by, "left") if by else found
    return out.crossJoin(F.broadcast(n)).select(*by, "exits", F.coalesce("covered", F.lit(0)).alias("covered"))


def false_load(alerts: DataFrame, rows: DataFrame, exits: DataFrame, by: list[str], groups: DataFrame) -> DataFrame:
    """People who stayed, and those of them ever alerted."""
    stayed = rows.select("person_id").distinct().join(exits, "person_id", "left_anti")
    n = stayed.agg(F.count("*").alias("stayed"))
    found = alerts.select("person_id", *by).join(stayed, "person_id").groupBy(*by).agg(F.count_distinct("person_id").alias("stayed_alerted"))
    out = groups.join(found, by, "left") if by else found
    return out.crossJoin(F.broadcast(n)).select(*by, "stayed", F.coalesce("stayed_alerted", F.lit(0)).alias("stayed_alerted"))


def coverage_by(exits: DataFrame, alerts: DataFrame, groups: DataFrame, group: str, window: int = WINDOW) -> DataFrame:
    """Regretted exits of each group, and how many of them had an alert in the months before:
    what no group exceeds is the ceiling of the catalogue for it."""
    lost = exits.where("left_regretted").select("person_id", "left_idx").join(groups, "person_id")
    hit = lost.join(alerts.select("person_id", "idx"), "person_id").where((F.col("idx") >= F.col("left_idx") - window) & (F.col("idx") < F.col("left_idx")))
    seen = lost.join(hit.select("person_id", F.lit(1).alias("hit")).distinct(), "person_id", "left")
    return seen.groupBy(group).agg(F.count("*").alias("exits"), F.count("hit").alias("covered"), (100.0 * F.count("hit") / F.count("*")).alias("covered_pct"))


def reach_by(rows: DataFrame, alerts: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """People of each group who were ever on the spine, and how many of them were reached."""
    people = rows.select("person_id").distinct().join(groups, "person_id")
    seen = people.join(alerts.select("person_id", F.lit(1).alias("hit")).distinct(), "person_id", "left")
    return seen.groupBy(group).agg(F.count("*").alias("people"), F.count("hit").alias("reached"), (100.0 * F.count("hit") / F.count("*")).alias("reached_pct"))


def signal_lift(universe: DataFrame, cut: DataFrame, exprs: dict[str, str]) -> DataFrame:
    """Lift of every signal over the base rate, in one aggregate: signal, n, rate, base, lift."""
    seen = universe.join(F.broadcast(cut), F.col("idx") <= F.col("cut"))
    one = seen.agg(
        F.count("*").alias("rows"), F.sum(F.col("leaves_regretted").cast("long")).alias("lost"),
        *[x for n, e in exprs.items() for x in (F.sum(F.when(F.expr(e), 1).otherwise(0)).alias(f"n_{n}"), F.sum(F.when(F.expr(e) & F.col("leaves_regretted"), 1).otherwise(0)).alias(f"k_{n}"))],
    )
    lines = F.array(*[F.struct(F.lit(n).alias("signal"), F.col(f"n_{n}").alias("n"), F.col(f"k_{n}").alias("k")) for n in exprs])
    out = one.select("rows", "lost", F.explode(lines).alias("x")).select("x.signal", "x.n", "x.k", (F.col("lost") / F.col("rows").cast("double")).alias("base"))
    return out.select("signal", "n", "k", "base", F.try_divide(F.try_divide(F.col("k").cast("double"), F.col("n").cast("double")), "base").alias("lift"))


def calibration(found: DataFrame, universe: DataFrame, rows: DataFrame, exits: DataFrame, cut: DataFrame, channel: str, quotas: list[int], cooldowns: list[int]) -> DataFrame:
    """Volume, precision, coverage and false load for every quota and cooldown of a channel.

    ``found`` are candidates with their previous row, which depends on neither: each cooldown
    filters them once, positions are ranked within it, and a quota is a bound on the position.
    Numbers are summed by position first, so quotas add no rows to count people over.
    """
    own = found.where(F.col("channel") == channel).withColumn("cooldown", F.explode(F.array(*[F.lit(c) for c in cooldowns])))
    own = own.where(rules.past_cooldown(F.col("cooldown")))
    placed = ranking.placed(own.select("person_id", "idx", "period", "cooldown", "priority", "compa"), ["period", "cooldown"], rules.queue_order()).select("person_id", "idx", "period", "cooldown", "position")
    alerts = placed.withColumn("quota", F.explode(F.filter(F.array(*[F.lit(q) for q in quotas]), lambda q: q >= F.col("position"))))
    by = ["quota", "cooldown"]
    groups = alerts.groupBy(*by).agg(F.count("*").alias("emitted"), F.count_distinct("period").alias("months"))
    out = groups.join(precision(alerts, universe, cut, *by), by, "left")
    keys = groups.select(*by)
    out = out.join(coverage(alerts, exits, by, keys), by).join(false_load(alerts, rows, exits, by, keys), by)
    return out.withColumn("a_month", F.col("emitted") / F.col("months").cast("double"))
