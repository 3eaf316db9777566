"""Are groups alerted and covered alike? A panel for each protected attribute, in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_PEOPLE = 40
LEAST_EXITS = 25
LOW, HIGH = 0.80, 1.25
LEAST_Z = 2.0
OTHERS = "others"


def memberships(rows: DataFrame, attributes: list[str], least: int = LEAST_PEOPLE) -> DataFrame:
    """(attribute, group, person_id): the greatest value of a person's months; groups under
    ``least`` people are folded into one."""
    each = rows.groupBy("person_id").agg(*[F.max(F.col(a).cast("string")).alias(a) for a in attributes])
    pairs = each.select("person_id", F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.coalesce(F.col(a), F.lit("unknown")).alias("value")) for a in attributes])).alias("x")).select("person_id", "x.*")
    sizes = pairs.groupBy("attribute", "value").agg(F.count("*").alias("n"))
    return pairs.join(sizes, ["attribute", "value"]).select("attribute", F.when(F.col("n") < least, F.lit(OTHERS)).otherwise(F.col("value")).alias("group"), "person_id")


def two_proportions(a: Column, n_a: Column, b: Column, n_b: Column) -> Column:
    """z of the difference of two shares; 0 without cases or without variance."""
    p = F.try_divide(a + b, n_a + n_b)
    se = F.sqrt(F.greatest(p * (1 - p) * (F.try_divide(F.lit(1.0), n_a) + F.try_divide(F.lit(1.0), n_b)), F.lit(0.0)))
    return F.coalesce(F.when(se > 0, F.try_divide(F.try_divide(a, n_a) - F.try_divide(b, n_b), se)), F.lit(0.0))


def panel(rows: DataFrame, alerts: DataFrame, universe: DataFrame, exits: DataFrame, attributes: list[str], channel: str, window: int = 6) -> DataFrame:
    """Per attribute and group: people, alerted, alerts, exposed months, regretted exits, covered.

    Alerts are those notified in ``channel``; coverage counts alerts of any channel.
    """
    groups = memberships(rows, attributes)
    notified = alerts.where("state = 'notified'")
    own = notified.where(F.col("channel") == channel).groupBy("person_id").agg(F.count("*").alias("alerts"))
    exposed = universe.groupBy("person_id").agg(F.count("*").alias("exposed"))
    lost = exits.where("left_regretted").select("person_id", "left_idx")
    hit = notified.join(lost, "person_id").where((F.col("idx") >= F.col("left_idx") - window) & (F.col("idx") < F.col("left_idx"))).select("person_id").distinct().withColumn("hit", F.lit(1))
    # One row for each person with all that is summed, so the groups are formed once.
    facts = exposed.join(own, "person_id", "full").join(lost.select("person_id", F.lit(1).alias("lost")), "person_id", "full").join(hit, "person_id", "left")
    return groups.join(facts, "person_id", "left").groupBy("attribute", "group").agg(
        F.count("*").alias("people"), F.count("alerts").alias("alerted"), F.coalesce(F.sum("alerts"), F.lit(0)).alias("alerts"), F.coalesce(F.sum("exposed"), F.lit(0)).alias("exposed"),
        F.count("lost").alias("exits"), F.count("hit").alias("covered"),
    )


def audited(panels: DataFrame) -> DataFrame:
    """Rates, indices against the largest group (by name among equals), z and what to review."""
    w = Window.partitionBy("attribute").orderBy(F.desc("people"), "group").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = lambda c: F.col(c).cast("double")
    first = lambda c: F.first(d(c)).over(w)
    out = panels.withColumns({"rate": F.try_divide(1000.0 * d("alerts"), d("exposed")), "coverage_all": F.try_divide(d("covered"), d("exits"))})
    out = out.withColumns({
        "reference": F.first("group").over(w), "alert_index": F.try_divide(F.col("rate"), first("rate")), "coverage_index_all": F.try_divide(F.col("coverage_all"), first("coverage_all")),
        "z_alert": two_proportions(d("alerts"), d("exposed"), first("alerts"), first("exposed")), "z_coverage": two_proportions(d("covered"), d("exits"), first("covered"), first("exits")),
    })
    enough = F.col("exits") >= LEAST_EXITS
    out = out.withColumns({"coverage": F.when(enough, F.col("coverage_all")), "coverage_index": F.when(enough, F.col("coverage_index_all"))})
    off = lambda i, z: F.coalesce(~F.col(i).between(LOW, HIGH) & (F.abs(z) > LEAST_Z), F.lit(False))
    flags = F.concat_ws(", ", F.when(off("alert_index", "z_alert"), "alert"), F.when(off("coverage_index", "z_coverage"), "coverage"))
    state = F.when(F.col("group") == F.col("reference"), "reference").when(flags != "", F.concat(F.lit("review: "), flags)).otherwise("ok")
    rounded = {c: F.round(c, 6) for c in ("rate", "coverage", "alert_index", "coverage_index", "z_alert", "z_coverage")}
    return out.withColumns({**rounded, "result": state}).drop("coverage_all", "coverage_index_all", "reference")
