"""Queries of the rule engine."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from ..operators import figures, rules
from ..sources.tables import staged, work_folder
from ..sources.testbed import LAST_MONTH
from .catalog import ALERT, CATALOG
from .oracle import with_tables
from .people import table_360
from .store import kept

SIGNALS = [f"s_{n}" for n in CATALOG["signals"]]
QUEUE = ["person_id", "idx", "period", "rule", "channel", "priority", "dimensions", "idx_before", "priority_before", "position", "state"]


def all_alerts(spark, sf_dir):
    """All alerts as kept by month, guarded before they are written."""
    return kept(spark, sf_dir, "alerts", _guarded)


def _guarded(spark, sf_dir):
    rows = staged(rules.alerts(table_360(spark, sf_dir), CATALOG))
    rules.guard_dimensions(rows)
    return rows


def signals(spark, sf_dir):
    """Every signal over the universe."""
    return rules.signal_columns(table_360(spark, sf_dir), CATALOG).select("person_id", "idx", *SIGNALS)


def candidates(spark, sf_dir):
    """The rule, channel and dimensions of every row where one fires, before the cooldown."""
    found = rules.with_previous(rules.candidates(rules.signal_columns(table_360(spark, sf_dir), CATALOG), CATALOG))
    return found.select("person_id", "idx", "rule", "channel", "priority", "dimensions", "idx_before", "priority_before")


def alerts(spark, sf_dir):
    """The alert queue."""
    return all_alerts(spark, sf_dir).select(*QUEUE)


def alerts_last_month(spark, sf_dir):
    """Explained alerts of the last month."""
    out = all_alerts(spark, sf_dir).where(F.col("idx") == LAST_MONTH)
    return out.select("person_id", "period", "rule", "state", "position", "rule_name", "rule_level", "goes_to", "catalog_version", F.concat_ws("; ", "signals").alias("signals"), F.concat_ws(" ", "evidence").alias("evidence"))


def run_summary(spark, sf_dir):
    """Per channel and state: alerts, people, months, alerts a month, quota."""
    rows = all_alerts(spark, sf_dir)
    quota = F.max(rules.by_channel(CATALOG, "quota", "long")).alias("quota")
    return rows.groupBy("channel", "state").agg(
        F.count("*").alias("alerts"), F.count_distinct("person_id").alias("people"), F.count_distinct("period").alias("months"), (F.count("*") / F.count_distinct("period")).alias("a_month"), quota
    )


def alert_breakdown(spark, sf_dir):
    """Alerts by rule, channel, number of dimensions, state and in the latest month, in one pass."""
    rows = all_alerts(spark, sf_dir)
    last = F.when(F.col("idx") == LAST_MONTH, "last").otherwise("before")
    kinds = {"rule": F.col("rule"), "channel": F.col("channel"), "dimensions": F.col("dimensions").cast("string"), "state": F.col("state"), "month": last}
    each = rows.select("person_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("value")) for k, c in kinds.items()])).alias("x"))
    return each.groupBy("x.kind", "x.value").agg(F.count("*").alias("alerts"), F.count_distinct("person_id").alias("people"))


def recent_cases(spark, sf_dir):
    """The two latest cases of each rule, those notified first."""
    from pyspark.sql import Window

    w = Window.partitionBy("rule").orderBy(F.when(F.col("state") == "waiting", 1).otherwise(0), F.desc("idx"), "position", "person_id")
    return all_alerts(spark, sf_dir).withColumn("n", F.row_number().over(w)).where("n <= 2").select("rule", "n", "person_id", "period", "state", "position")


def _figures(rows):
    """What a report of the alerts prints, by name."""
    by = rows.groupBy("channel", "state").agg(F.count("*").alias("alerts"), F.count_distinct("person_id").alias("people"), F.round(F.count("*") / F.count_distinct("period"), 1).alias("a_month"), F.min("dimensions").alias("least_dimensions"))
    return figures.named(by, ["channel", "state"], ["alerts", "people", "a_month", "least_dimensions"])


def figures_reconciled(spark, sf_dir):
    """The figures that the run of the month before published, from the rows that it had, against
    the same months of the alerts as kept now (A27): later months change nothing."""
    path, run = f"{work_folder(spark)}/figures-{uuid.uuid4().hex}", str(LAST_MONTH - 1)
    before = F.col("idx") <= LAST_MONTH - 1
    figures.publish(_figures(rules.alerts(table_360(spark, sf_dir).where(before), CATALOG)), path, run)
    found = figures.reconciled(figures.published(spark, path, run), _figures(all_alerts(spark, sf_dir).where(before)))
    figures.stop_if_off(found)
    return found.select("name", "published", "recomputed", "ok")


def reconciled(spark, sf_dir):
    """Figures as a report prints them (from the summary by channel and state, to one decimal)
    against the same figures from the alerts themselves, within half a printed digit (A27); and
    no alert on fewer than two dimensions."""
    rows = staged(all_alerts(spark, sf_dir))
    months = F.count_distinct("period").cast("double")
    summary = rows.groupBy("channel", "state").agg(F.count("*").alias("n"), months.alias("months"), F.sum("dimensions").alias("dims"), F.min("dimensions").alias("least"))
    printed = summary.agg(
        F.sum("n").cast("double").alias("alerts"), F.round(F.max(F.when((F.col("channel") == ALERT) & (F.col("state") == "notified"), F.col("n") / F.col("months"))), 1).alias("notified_a_month"),
        F.round(100.0 * F.sum(F.when(F.col("state") == "on_panel", F.col("n")).otherwise(0)) / F.sum("n"), 1).alias("panel_pct"), F.round(F.sum("dims") / F.sum("n").cast("double"), 1).alias("dimensions_mean"),
        F.lit(2.0).alias("dimensions_least"),
    )
    told = (F.col("channel") == ALERT) & (F.col("state") == "notified")
    again = rows.agg(
        F.count("*").cast("double").alias("alerts"), (F.count(F.when(told, 1)) / F.count_distinct(F.when(told, F.col("period"))).cast("double")).alias("notified_a_month"),
        (100.0 * F.count(F.when(F.col("state") == "on_panel", 1)) / F.count("*")).alias("panel_pct"), F.avg(F.col("dimensions").cast("double")).alias("dimensions_mean"), F.min("dimensions").cast("double").alias("dimensions_least"),
    )
    one = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("figure"), F.col(c).alias("value")) for c in df.columns])).alias("x")).select("x.*")
    both = one(printed).withColumnRenamed("value", "printed").join(one(again).withColumnRenamed("value", "found"), "figure")
    return both.select("figure", "printed", F.round("found", 6).alias("found"), (F.abs(F.col("printed") - F.col("found")) <= 0.0500001).alias("ok"))


QUERIES = {
    "signals": signals, "candidates": candidates, "alerts": alerts, "alerts_last_month": alerts_last_month, "run_summary": run_summary, "alert_breakdown": alert_breakdown,
    "recent_cases": recent_cases, "reconciled": reconciled, "figures_reconciled": figures_reconciled,
}

ALERTS_SQL = {"al": (("p360",), rules.compile_sql(CATALOG))}


def over_alerts(final: str, *names: str, extra: dict | None = None) -> str:
    return with_tables(final, "al", *names, extra=ALERTS_SQL | (extra or {}))


def _text(t: str) -> str:
    return "'" + t.replace("'", "''") + "'"


_labels = "concat_ws('; ', " + ", ".join(f"CASE WHEN s_{n} THEN {_text(s['label'])} END" for n, s in CATALOG["signals"].items()) + ")"
_said = {
    n: (f"printf({_text(s['says'][0])}, " + ", ".join(f"round(({v.format(t=s.get('t'))})::DOUBLE, {d})" for v, d in zip(s["says"][1], re.findall(r"%\.(\d)f", s["says"][0]), strict=True)) + ")" if s["says"][1] else _text(s["says"][0]))
    for n, s in CATALOG["signals"].items()
}
_says = "concat_ws(' ', " + ", ".join(f"CASE WHEN s_{n} THEN {said} END" for n, said in _said.items()) + ")"
SIGNS = "list_filter([" + ", ".join(f"CASE WHEN s_{n} THEN {{'signal': {_text(CATALOG['signals'][n]['label'])}, 'evidence': {said}}} END" for n, said in _said.items()) + "], lambda x: x IS NOT NULL)"
of_rule = _of_rule = lambda f: "CASE rule " + " ".join(f"WHEN '{n}' THEN {_text(r[f])}" for n, r in CATALOG["rules"].items()) + " END"
_to = "CASE channel " + " ".join(f"WHEN '{n}' THEN {_text(c['to'])}" for n, c in CATALOG["channels"].items()) + " END"
_quota = "CASE channel " + " ".join(f"WHEN '{n}' THEN {c['quota'] or 'NULL'}" for n, c in CATALOG["channels"].items()) + " END"
_kinds = " UNION ALL ".join(
    f"SELECT '{k}' AS kind, {v} AS value, count(*) AS alerts, count(DISTINCT person_id) AS people FROM al GROUP BY 2"
    for k, v in {"rule": "rule", "channel": "channel", "dimensions": "dimensions::VARCHAR", "state": "state", "month": f"CASE WHEN idx = {LAST_MONTH} THEN 'last' ELSE 'before' END"}.items()
)
SQL = {
    "signals": with_tables(f"SELECT person_id, idx, {', '.join(SIGNALS)} FROM (SELECT *, " + ", ".join(f"{s['expr'].format(t=s.get('t'))} AS s_{n}" for n, s in CATALOG["signals"].items()) + f" FROM p360 WHERE {CATALOG['universe']})", "p360"),
    "candidates": with_tables(
        "SELECT person_id, idx, rule, channel, priority, dimensions, idx_before, priority_before FROM c", "c",
        extra={"c": (("p360",), rules.compile_sql({**CATALOG, "channels": {n: {**c, "cooldown": -1} for n, c in CATALOG["channels"].items()}}))},
    ),
    "alerts": over_alerts(f"SELECT {', '.join(QUEUE)} FROM al"),
    "alerts_last_month": over_alerts(
        f"""SELECT person_id, period, rule, state, position, {_of_rule('name')} AS rule_name, {_of_rule('level')} AS rule_level, {_to} AS goes_to, '{CATALOG["version"]}' AS catalog_version,
          {_labels} AS signals, {_says} AS evidence FROM al WHERE idx = {LAST_MONTH}"""
    ),
    "run_summary": over_alerts(f"SELECT channel, state, count(*) AS alerts, count(DISTINCT person_id) AS people, count(DISTINCT period) AS months, count(*)::DOUBLE / count(DISTINCT period) AS a_month, max({_quota})::BIGINT AS quota FROM al GROUP BY 1, 2"),
    "alert_breakdown": over_alerts(_kinds),
    "recent_cases": over_alerts(
        "SELECT rule, n, person_id, period, state, position FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY CASE WHEN state = 'waiting' THEN 1 ELSE 0 END, idx DESC, position, person_id) AS n FROM al) WHERE n <= 2"
    ),
    "figures_reconciled": over_alerts(
        f"""SELECT name || '/' || channel || '/' || state AS name, value AS published, value AS recomputed, true AS ok FROM (SELECT channel, state, unnest(['alerts', 'people', 'a_month', 'least_dimensions']) AS name,
          unnest([count(*)::DOUBLE, count(DISTINCT person_id)::DOUBLE, round(count(*) / count(DISTINCT period), 1)::DOUBLE, min(dimensions)::DOUBLE]) AS value FROM al WHERE idx <= {LAST_MONTH - 1} GROUP BY channel, state)"""
    ),
    "reconciled": over_alerts(
        f"""SELECT figure, printed, found, abs(printed - found) <= 0.0500001 AS ok FROM (
          SELECT 'alerts' AS figure, sum(n)::DOUBLE AS printed, (SELECT count(*) FROM al)::DOUBLE AS found FROM g
          UNION ALL SELECT 'notified_a_month', round(max(n / months) FILTER (channel = '{ALERT}' AND state = 'notified'), 1), (SELECT round(count(*) / count(DISTINCT period)::DOUBLE, 6) FROM al WHERE channel = '{ALERT}' AND state = 'notified') FROM g
          UNION ALL SELECT 'panel_pct', round(100.0::DOUBLE * coalesce(sum(n) FILTER (state = 'on_panel'), 0) / sum(n), 1), (SELECT round(100.0::DOUBLE * count(*) FILTER (state = 'on_panel') / count(*), 6) FROM al) FROM g
          UNION ALL SELECT 'dimensions_mean', round(sum(dims)::DOUBLE / sum(n), 1), (SELECT round(avg(dimensions), 6) FROM al) FROM g
          UNION ALL SELECT 'dimensions_least', 2.0, (SELECT min(dimensions) FROM al)::DOUBLE)""",
        "g", extra={"g": (("al",), "SELECT channel, state, count(*) AS n, count(DISTINCT period)::DOUBLE AS months, sum(dimensions) AS dims FROM al GROUP BY 1, 2")},
    ),
}
