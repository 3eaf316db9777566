"""Queries of the backtest and the fairness audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtest, fairness, rules
from ..sources.tables import staged
from ..sources.testbed import staging
from .catalog import ALERT, CATALOG
from .early_warning import all_alerts, over_alerts
from .oracle import with_tables
from .people import table_360

UNIVERSE = CATALOG["universe"]
ATTRIBUTES = ["gender", "age_band", "tenure_band", "mode", "country", "family"]
QUOTAS, COOLDOWNS = [5, 15, 25, 35, 50, 75, 100, 1_000_000], [0, 3, 6]
EXPRS = {n: s["expr"].format(t=s.get("t")) for n, s in CATALOG["signals"].items()} | CATALOG["discarded"]


def _parts(spark, sf_dir):
    rows = table_360(spark, sf_dir)
    exits = backtest.observed_exits(rows)
    return rows, exits, backtest.labelled(rows, exits, UNIVERSE), backtest.last_observed(rows)


def _alerts(spark, sf_dir):
    return all_alerts(spark, sf_dir).select("person_id", "idx", "period", "channel", "state")


def observed_exits(spark, sf_dir):
    """Who left, when first seen so (A4)."""
    return backtest.observed_exits(table_360(spark, sf_dir))


def outcomes(spark, sf_dir):
    """Outcome labels of the universe (A5)."""
    return _parts(spark, sf_dir)[2].select("person_id", "idx", "leaves", "leaves_regretted")


def backtest_summary(spark, sf_dir):
    """Precision, lift, coverage and false load of the notified alerts."""
    rows, exits, universe, cut = _parts(spark, sf_dir)
    alerts = _alerts(spark, sf_dir).where("state = 'notified'")
    one = backtest.precision(alerts, universe, cut).crossJoin(backtest.base_rates(universe, cut))
    one = one.crossJoin(backtest.coverage(alerts, exits, [], None)).crossJoin(backtest.false_load(alerts, rows, exits, [], None))
    volume = alerts.agg((F.count("*") / F.count_distinct("period").cast("double")).alias("a_month"))
    return one.crossJoin(volume).select(
        "alerts", "precision_any", "precision_regretted", "rows", "base_any", "base_regretted", F.try_divide("precision_any", "base_any").alias("lift_any"),
        F.try_divide("precision_regretted", "base_regretted").alias("lift_regretted"), "exits", "covered", "stayed", "stayed_alerted", "a_month",
    )


def signal_lift(spark, sf_dir):
    """Lift of all signals, used and discarded (A12). Signals are worked out before exits are joined:
    a flag for each goes through the exchange, not the columns that they look at."""
    rows, exits, _, cut = _parts(spark, sf_dir)
    fired = rows.where(UNIVERSE).select("person_id", "idx", *[F.expr(e).alias(f"f_{n}") for n, e in EXPRS.items()])
    return backtest.signal_lift(backtest.labelled(fired, exits, "true"), cut, {n: f"f_{n}" for n in EXPRS})


def calibration(spark, sf_dir):
    """The curve over quotas and cooldowns of the channel with a quota."""
    return _calibrated(spark, sf_dir, QUOTAS)


def _calibrated(spark, sf_dir, quotas):
    rows, exits, universe, cut = _parts(spark, sf_dir)
    found = rules.with_previous(rules.candidates(rules.signal_columns(rows, CATALOG), CATALOG)).where(F.col("channel") == ALERT)
    found = staged(found.select("person_id", "idx", "period", "channel", "priority", "compa", "idx_before", "priority_before"))
    return backtest.calibration(found, universe, rows, exits, cut, ALERT, quotas, COOLDOWNS)


def cooldown_cost(spark, sf_dir):
    """What a cooldown saves in volume and costs in coverage, without a quota."""
    curve = staged(_calibrated(spark, sf_dir, QUOTAS[-1:]))
    none = F.broadcast(curve.where("cooldown = 0").select(F.col("emitted").alias("e0"), F.col("covered").alias("c0")))
    return curve.where("cooldown > 0").crossJoin(none).select("cooldown", (100.0 * (F.col("e0") - F.col("emitted")) / F.col("e0")).alias("volume_cut_pct"), (100.0 * (F.col("c0") - F.col("covered")) / F.col("exits")).alias("coverage_lost_points"))


def newest_recovered(spark, sf_dir):
    """Regretted exits by tenure cohort: share, index by head and by exposed month, covered by alerts and by panels."""
    rows, exits, _, _ = _parts(spark, sf_dir)
    lost = exits.where("left_regretted").select("person_id", "left_idx")
    at_exit = rows.join(lost, "person_id").where("idx = left_idx").select("person_id", "tenure_band", "left_idx")
    alerts = _alerts(spark, sf_dir).select("person_id", "idx", "state")
    hits = at_exit.join(alerts, "person_id", "left").groupBy("person_id", "tenure_band").agg(
        F.max(F.when((F.col("state") == "notified") & (F.col("idx") >= F.col("left_idx") - 6) & (F.col("idx") < F.col("left_idx")), 1).otherwise(0)).alias("by_alert"),
        F.max(F.when((F.col("state") == "on_panel") & (F.col("idx") >= F.col("left_idx") - 6) & (F.col("idx") < F.col("left_idx")), 1).otherwise(0)).alias("by_panel"),
    )
    months = rows.groupBy("tenure_band").agg(F.count("*").alias("months"), F.count_distinct("person_id").alias("people"))
    return months.join(hits.groupBy("tenure_band").agg(F.count("*").alias("exits"), F.sum("by_alert").alias("by_alert"), F.sum(F.greatest("by_alert", "by_panel")).alias("by_either")), "tenure_band", "left").select(
        "tenure_band", "people", "months", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("exits", "by_alert", "by_either")],
        (1000.0 * F.coalesce("exits", F.lit(0)) / F.col("months")).alias("exits_per_1000_months"), (100.0 * F.coalesce("exits", F.lit(0)) / F.col("people")).alias("exits_per_100_people"),
    )


def ceiling_by_profile(spark, sf_dir):
    """Coverage of regretted exits by what people really are, which no rule may read."""
    rows, exits, _, _ = _parts(spark, sf_dir)
    return backtest.coverage_by(exits, _alerts(spark, sf_dir).where("state = 'notified'"), staging(spark, sf_dir, "profiles"), "profile")


def panel_reach(spark, sf_dir):
    """Whom the panels reach, of the whole population by profile."""
    rows = table_360(spark, sf_dir)
    return backtest.reach_by(rows, _alerts(spark, sf_dir).where("state = 'on_panel'"), staging(spark, sf_dir, "profiles"), "profile")


def fairness_panel(spark, sf_dir):
    """Counts of every group of six attributes."""
    rows, exits, universe, _ = _parts(spark, sf_dir)
    return fairness.panel(rows, _alerts(spark, sf_dir), universe, exits, ATTRIBUTES, ALERT)


def fairness_audit(spark, sf_dir):
    """Indices, z and review flags of the panel."""
    return fairness.audited(fairness_panel(spark, sf_dir))


QUERIES = {f.__name__: f for f in (observed_exits, outcomes, backtest_summary, signal_lift, calibration, cooldown_cost, newest_recovered, ceiling_by_profile, panel_reach, fairness_panel, fairness_audit)}

X = {
    "ex": (("p360",), "SELECT person_id, min(idx) AS left_idx, bool_or(regretted) AS left_regretted FROM p360 WHERE exit_idx IS NOT NULL AND NOT active GROUP BY 1"),
    "un": (("p360", "ex"), f"SELECT p.*, coalesce(left_idx - idx BETWEEN 1 AND 6, false) AS leaves, coalesce(left_idx - idx BETWEEN 1 AND 6 AND left_regretted, false) AS leaves_regretted FROM p360 p LEFT JOIN ex USING (person_id) WHERE {UNIVERSE}"),
    "cut": (("p360",), "SELECT max(idx) - 6 AS cut FROM p360"),
    "nt": (("al",), "SELECT * FROM al WHERE state = 'notified'"),
    "cand": (("p360",), rules.compile_sql({**CATALOG, "channels": {n: {**c, "cooldown": -1} for n, c in CATALOG["channels"].items()}})),
}
_share = lambda c: f"count(*) FILTER ({c})::DOUBLE / nullif(count(*), 0)"
_curve = {
    "pl": (("cand",), f"SELECT person_id, idx, period, cooldown, row_number() OVER (PARTITION BY period, cooldown ORDER BY priority, compa ASC NULLS LAST, person_id) AS position FROM cand, (SELECT unnest({COOLDOWNS}) AS cooldown) WHERE channel = '{ALERT}' AND (idx_before IS NULL OR idx - idx_before > cooldown OR priority < priority_before)"),
    "qa": (("pl",), f"SELECT * FROM pl JOIN (SELECT unnest({QUOTAS}) AS quota) ON position <= quota"),
    "curve": (("qa", "un", "cut", "ex"), f"""SELECT g.*, p.alerts, p.precision_any, p.precision_regretted, (SELECT count(*) FROM ex WHERE left_regretted) AS exits, coalesce(covered, 0) AS covered,
        (SELECT count(DISTINCT person_id) FROM p360 WHERE person_id NOT IN (SELECT person_id FROM ex)) AS stayed, coalesce(stayed_alerted, 0) AS stayed_alerted, emitted::DOUBLE / months AS a_month
      FROM (SELECT quota, cooldown, count(*) AS emitted, count(DISTINCT period) AS months FROM qa GROUP BY 1, 2) g
      LEFT JOIN (SELECT quota, cooldown, count(*) AS alerts, {_share('leaves')} AS precision_any, {_share('leaves_regretted')} AS precision_regretted FROM qa JOIN un USING (person_id, idx) WHERE idx <= (SELECT cut FROM cut) GROUP BY 1, 2) p USING (quota, cooldown)
      LEFT JOIN (SELECT quota, cooldown, count(DISTINCT person_id) AS covered FROM qa JOIN ex USING (person_id) WHERE left_regretted AND idx BETWEEN left_idx - 6 AND left_idx - 1 GROUP BY 1, 2) c USING (quota, cooldown)
      LEFT JOIN (SELECT quota, cooldown, count(DISTINCT person_id) AS stayed_alerted FROM qa WHERE person_id NOT IN (SELECT person_id FROM ex) GROUP BY 1, 2) f USING (quota, cooldown)"""),
}
_members = " UNION ALL ".join(f"SELECT '{a}' AS attribute, coalesce(max({a}), 'unknown') AS value, person_id FROM p360 GROUP BY person_id" for a in ATTRIBUTES)
_fair = {
    "mb": (("p360",), f"SELECT attribute, CASE WHEN count(*) OVER (PARTITION BY attribute, value) < 40 THEN 'others' ELSE value END AS \"group\", person_id FROM ({_members})"),
    "fp": (("mb", "nt", "un", "ex"), f"""SELECT attribute, "group", count(*) AS people, count(a.n) AS alerted, coalesce(sum(a.n), 0)::BIGINT AS alerts, coalesce(sum(u.n), 0)::BIGINT AS exposed, count(l.person_id) AS exits, count(h.person_id) AS covered
      FROM mb LEFT JOIN (SELECT person_id, count(*) AS n FROM nt WHERE channel = '{ALERT}' GROUP BY 1) a USING (person_id) LEFT JOIN (SELECT person_id, count(*) AS n FROM un GROUP BY 1) u USING (person_id)
      LEFT JOIN (SELECT person_id FROM ex WHERE left_regretted) l ON l.person_id = mb.person_id
      LEFT JOIN (SELECT DISTINCT person_id FROM nt JOIN ex USING (person_id) WHERE left_regretted AND idx BETWEEN left_idx - 6 AND left_idx - 1) h ON h.person_id = mb.person_id GROUP BY 1, 2"""),
}
_z = lambda a, n, b, m: (
    f"coalesce(CASE WHEN sqrt(greatest(({a} + {b}) / nullif({n} + {m}, 0) * (1 - ({a} + {b}) / nullif({n} + {m}, 0)) * (1 / nullif({n}, 0) + 1 / nullif({m}, 0)), 0)) > 0 "
    f"THEN ({a} / nullif({n}, 0) - {b} / nullif({m}, 0)) / sqrt(greatest(({a} + {b}) / nullif({n} + {m}, 0) * (1 - ({a} + {b}) / nullif({n} + {m}, 0)) * (1 / nullif({n}, 0) + 1 / nullif({m}, 0)), 0)) END, 0)"
)
SQL = {
    "observed_exits": with_tables("SELECT * FROM ex", "ex", extra=X),
    "outcomes": with_tables("SELECT person_id, idx, leaves, leaves_regretted FROM un", "un", extra=X),
    "backtest_summary": over_alerts(
        f"""SELECT alerts, precision_any, precision_regretted, rows, base_any, base_regretted, precision_any / nullif(base_any, 0) AS lift_any, precision_regretted / nullif(base_regretted, 0) AS lift_regretted, exits, covered, stayed, stayed_alerted, a_month FROM
        (SELECT count(*) AS alerts, {_share('leaves')} AS precision_any, {_share('leaves_regretted')} AS precision_regretted FROM nt JOIN un USING (person_id, idx) WHERE idx <= (SELECT cut FROM cut)),
        (SELECT count(*) AS rows, {_share('leaves')} AS base_any, {_share('leaves_regretted')} AS base_regretted FROM un WHERE idx <= (SELECT cut FROM cut)),
        (SELECT count(*) AS exits FROM ex WHERE left_regretted), (SELECT count(DISTINCT person_id) AS covered FROM nt JOIN ex USING (person_id) WHERE left_regretted AND idx BETWEEN left_idx - 6 AND left_idx - 1),
        (SELECT count(DISTINCT person_id) AS stayed FROM p360 WHERE person_id NOT IN (SELECT person_id FROM ex)), (SELECT count(DISTINCT person_id) AS stayed_alerted FROM nt WHERE person_id NOT IN (SELECT person_id FROM ex)),
        (SELECT count(*)::DOUBLE / count(DISTINCT period) AS a_month FROM nt)""",
        "nt", "un", "cut", extra=X,
    ),
    "ceiling_by_profile": over_alerts(
        """SELECT profile, count(*) AS exits, count(h.person_id) AS covered, 100.0::DOUBLE * count(h.person_id) / count(*) AS covered_pct FROM ex JOIN profiles USING (person_id)
        LEFT JOIN (SELECT DISTINCT person_id FROM nt JOIN ex USING (person_id) WHERE idx BETWEEN left_idx - 6 AND left_idx - 1) h ON h.person_id = ex.person_id WHERE left_regretted GROUP BY 1""", "nt", "ex", "profiles", extra=X,
    ),
    "panel_reach": over_alerts(
        """SELECT profile, count(*) AS people, count(r.person_id) AS reached, 100.0::DOUBLE * count(r.person_id) / count(*) AS reached_pct FROM (SELECT DISTINCT person_id FROM p360) p JOIN profiles USING (person_id)
        LEFT JOIN (SELECT DISTINCT person_id FROM al WHERE state = 'on_panel') r ON r.person_id = p.person_id GROUP BY 1""", "profiles", extra=X,
    ),
    "signal_lift": with_tables(
        " UNION ALL ".join(
            f"SELECT '{n}' AS signal, count(*) FILTER ({e}) AS n, count(*) FILTER (({e}) AND leaves_regretted) AS k, {_share('leaves_regretted')} AS base, (count(*) FILTER (({e}) AND leaves_regretted)::DOUBLE / nullif(count(*) FILTER ({e}), 0)) / nullif({_share('leaves_regretted')}, 0) AS lift FROM un WHERE idx <= (SELECT cut FROM cut)"
            for n, e in EXPRS.items()
        ), "un", "cut", extra=X,
    ),
    "calibration": with_tables("SELECT * FROM curve", "curve", extra=X | _curve),
    "cooldown_cost": with_tables(
        f"SELECT a.cooldown, 100.0::DOUBLE * (b.emitted - a.emitted) / b.emitted AS volume_cut_pct, 100.0::DOUBLE * (b.covered - a.covered) / a.exits AS coverage_lost_points FROM curve a, curve b WHERE a.quota = {QUOTAS[-1]} AND b.quota = a.quota AND b.cooldown = 0 AND a.cooldown > 0",
        "curve", extra=X | _curve,
    ),
    "newest_recovered": over_alerts(
        """SELECT tenure_band, people, months, coalesce(exits, 0) AS exits, coalesce(by_alert, 0)::BIGINT AS by_alert, coalesce(by_either, 0)::BIGINT AS by_either, 1000.0::DOUBLE * coalesce(exits, 0) / months AS exits_per_1000_months, 100.0::DOUBLE * coalesce(exits, 0) / people AS exits_per_100_people
        FROM (SELECT tenure_band, count(*) AS months, count(DISTINCT person_id) AS people FROM p360 GROUP BY 1)
        LEFT JOIN (SELECT tenure_band, count(*) AS exits, sum(a) AS by_alert, sum(greatest(a, p)) AS by_either FROM (
          SELECT p.person_id, p.tenure_band, max(CASE WHEN al.state = 'notified' AND al.idx BETWEEN left_idx - 6 AND left_idx - 1 THEN 1 ELSE 0 END) AS a, max(CASE WHEN al.state = 'on_panel' AND al.idx BETWEEN left_idx - 6 AND left_idx - 1 THEN 1 ELSE 0 END) AS p
          FROM p360 p JOIN ex ON ex.person_id = p.person_id AND left_regretted AND p.idx = left_idx LEFT JOIN al ON al.person_id = p.person_id GROUP BY 1, 2) GROUP BY 1) USING (tenure_band)""",
        "ex", extra=X,
    ),
    "fairness_panel": over_alerts("SELECT * FROM fp", "fp", extra=X | _fair),
    "fairness_audit": over_alerts(
        f"""SELECT attribute, "group", people, alerted, alerts, exposed, exits, covered, round(rate, 6) AS rate, round(CASE WHEN exits >= 25 THEN cov END, 6) AS coverage, round(ai, 6) AS alert_index, round(CASE WHEN exits >= 25 THEN ci END, 6) AS coverage_index,
          round(za, 6) AS z_alert, round(zc, 6) AS z_coverage, CASE WHEN "group" = ref THEN 'reference' WHEN fa AND fc THEN 'review: alert, coverage' WHEN fa THEN 'review: alert' WHEN fc THEN 'review: coverage' ELSE 'ok' END AS result FROM (
          SELECT *, coalesce(NOT ai BETWEEN 0.8 AND 1.25 AND abs(za) > 2, false) AS fa, coalesce(exits >= 25 AND NOT ci BETWEEN 0.8 AND 1.25 AND abs(zc) > 2, false) AS fc FROM (
            SELECT *, rate / nullif(first(rate) OVER w, 0) AS ai, cov / nullif(first(cov) OVER w, 0) AS ci, first("group") OVER w AS ref, {_z('alerts::DOUBLE', 'exposed::DOUBLE', 'first(alerts::DOUBLE) OVER w', 'first(exposed::DOUBLE) OVER w')} AS za,
              {_z('covered::DOUBLE', 'exits::DOUBLE', 'first(covered::DOUBLE) OVER w', 'first(exits::DOUBLE) OVER w')} AS zc
            FROM (SELECT *, 1000.0::DOUBLE * alerts / nullif(exposed, 0) AS rate, covered::DOUBLE / nullif(exits, 0) AS cov FROM fp)
            WINDOW w AS (PARTITION BY attribute ORDER BY people DESC, "group" ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)))""",
        "fp", extra=X | _fair,
    ),
}
