"""From signals to alerts: one rule for a person-month, a cooldown, and a queue with a quota."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import placed

CARRIED = ["person_id", "idx", "period"]


class CatalogError(ValueError):
    """The catalogue breaks one of its guarantees."""


def names_in(expr: str) -> set[str]:
    return set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", expr))


def branches(rule: dict) -> list[list[str]]:
    """The smallest sets of signals that fire a rule."""
    return [[*rule["all"], s] for s in rule["any"]] or [list(rule["all"])]


def check_catalog(catalog: dict) -> None:
    """Raises CatalogError at the first guarantee that does not hold: no forbidden column in a
    signal or the universe; rules name known signals and channels; every branch of a rule has
    two dimensions and a risk signal; priorities differ; modes and quotas agree."""
    signals, forbidden = catalog["signals"], set(catalog["forbidden"])
    for where, expr in [("universe", catalog["universe"]), *((n, s["expr"]) for n, s in signals.items())]:
        if bad := names_in(expr) & forbidden:
            raise CatalogError(f"{where} reads {sorted(bad)}")
    seen: dict[int, str] = {}
    for name, rule in catalog["rules"].items():
        if not rule["all"]:
            raise CatalogError(f"{name} has no signal that it needs")
        if unknown := {*rule["all"], *rule["any"]} - signals.keys():
            raise CatalogError(f"{name} names unknown signals {sorted(unknown)}")
        for branch in branches(rule):
            if len({signals[s]["dimension"] for s in branch}) < 2:
                raise CatalogError(f"{name} can fire on one dimension: {branch}")
            if all(signals[s]["kind"] != "risk" for s in branch):
                raise CatalogError(f"{name} can fire without a risk: {branch}")
        if rule["channel"] not in catalog["channels"]:
            raise CatalogError(f"{name} goes to an unknown channel")
        if rule["priority"] in seen:
            raise CatalogError(f"{name} and {seen[rule['priority']]} share a priority")
        seen[rule["priority"]] = name
    for name, channel in catalog["channels"].items():
        if (channel["mode"] == "alert") != (channel["quota"] is not None):
            raise CatalogError(f"{name}: alerts have a quota, panels have none")


def allowed_columns(catalog: dict, columns: list[str]) -> list[str]:
    """Columns that the catalogue's expressions name, in the order of the table: outcome labels
    can't be read, since no expression may name them."""
    exprs = [catalog["universe"], *(s["expr"] for s in catalog["signals"].values()), *(e for s in catalog["signals"].values() for e in s["says"][1])]
    named = set().union(*map(names_in, exprs)) | {*CARRIED, "compa"}
    return [c for c in columns if c in named]


def signal_columns(rows: DataFrame, catalog: dict) -> DataFrame:
    """The universe with ``s_<signal>`` for every signal; a comparison with null stays null."""
    rows = rows.where(catalog["universe"]).select(*allowed_columns(catalog, rows.columns))
    return rows.withColumns({f"s_{n}": F.expr(s["expr"].format(t=s.get("t"))) for n, s in catalog["signals"].items()})


def fires(rule: dict) -> Column:
    need = reduce(lambda a, b: a & b, [F.col(f"s_{s}") for s in rule["all"]])
    return need & reduce(lambda a, b: a | b, [F.col(f"s_{s}") for s in rule["any"]]) if rule["any"] else need


def _by_rule(catalog: dict, field: str) -> Column:
    out = None
    for name, rule in catalog["rules"].items():
        out = (F if out is None else out).when(F.col("rule") == name, F.lit(rule[field]))
    return out


def candidates(signals: DataFrame, catalog: dict) -> DataFrame:
    """Rows where a rule fires, with the first rule by priority, its channel and priority, and
    the number of dimensions that fire."""
    dims: dict[str, list[str]] = {}
    for n, s in catalog["signals"].items():
        dims.setdefault(s["dimension"], []).append(n)
    n_dims = reduce(lambda a, b: a + b, [F.when(reduce(lambda a, b: a | b, [F.col(f"s_{s}") for s in group]), 1).otherwise(0) for group in dims.values()])
    by_priority = sorted(catalog["rules"].items(), key=lambda x: x[1]["priority"])
    # A generator binds the rule: a later condition on rule or channel is not rewritten into conditions on all signals.
    each = [F.when(fires(r), F.struct(F.lit(n).alias("rule"), F.lit(r["channel"]).alias("channel"), F.lit(r["priority"]).alias("priority"))) for n, r in by_priority]
    return signals.withColumn("_first", F.explode(F.slice(F.array_compact(F.array(*each)), 1, 1))).select(*signals.columns, "_first.*", n_dims.alias("dimensions"))


def with_previous(rows: DataFrame) -> DataFrame:
    """Month and priority of the person's previous candidate row in the channel."""
    w = Window.partitionBy("person_id", "channel").orderBy("idx")
    return rows.withColumns({"idx_before": F.lag("idx").over(w), "priority_before": F.lag("priority").over(w)})


def by_channel(catalog: dict, field: str, kind: str) -> Column:
    out = None
    for name, channel in catalog["channels"].items():
        out = (F if out is None else out).when(F.col("channel") == name, F.lit(channel[field]).cast(kind))
    return out


def past_cooldown(months: Column) -> Column:
    """No candidate row before, a longer gap, or a higher priority than then. The row before
    counts whether it was let through or not."""
    return F.col("idx_before").isNull() | (F.col("idx") - F.col("idx_before") > months) | (F.col("priority") < F.col("priority_before"))


def queue_order() -> list[Column]:
    return [F.col("priority"), F.asc_nulls_last("compa"), F.col("person_id")]


def queued(rows: DataFrame, catalog: dict, *extra: str) -> DataFrame:
    """Position within (period, channel) by priority, pay and id, and what becomes of the row."""
    quota = by_channel(catalog, "quota", "long")
    state = F.when(quota.isNull(), "on_panel").when(F.col("position") <= quota, "notified").otherwise("waiting")
    return placed(rows, ["period", "channel", *extra], queue_order()).withColumn("state", state)


def explained(rows: DataFrame, catalog: dict) -> DataFrame:
    """Labels and filled sentences of the signals that are true, and the rule's texts."""
    labels, says = [], []
    for n, s in catalog["signals"].items():
        text, values = s["says"]
        said = F.format_string(text, *[F.expr(v.format(t=s.get("t"))).cast("double") for v in values]) if values else F.lit(text)
        labels.append(F.when(F.col(f"s_{n}"), F.lit(s["label"])))
        says.append(F.when(F.col(f"s_{n}"), said))
    texts = {f: _by_rule(catalog, f) for f in ("level", "name", "reading", "action")}
    out = rows.withColumns({"signals": F.array_compact(F.array(*labels)), "evidence": F.array_compact(F.array(*says)), **{f"rule_{f}": c for f, c in texts.items()}})
    return out.withColumns({"goes_to": by_channel(catalog, "to", "string"), "catalog_version": F.lit(catalog["version"])})


def alerts(rows: DataFrame, catalog: dict) -> DataFrame:
    """The whole chain over a person-month table."""
    check_catalog(catalog)
    found = with_previous(candidates(signal_columns(rows, catalog), catalog))
    kept = found.where(past_cooldown(by_channel(catalog, "cooldown", "int")))
    return explained(queued(kept, catalog), catalog)


def guard_dimensions(rows: DataFrame) -> None:
    """Raises if an alert rests on fewer than two dimensions."""
    least = rows.agg(F.min("dimensions")).first()[0]
    if least is not None and least < 2:
        raise CatalogError(f"an alert rests on {least} dimension")


def compile_sql(catalog: dict, table: str = "p360", spark: bool = False) -> str:
    """Signals, rule, cooldown and queue as SQL text."""
    signals = ", ".join(f"{s['expr'].format(t=s.get('t'))} AS s_{n}" for n, s in catalog["signals"].items())
    ordered = sorted(catalog["rules"].items(), key=lambda x: x[1]["priority"])

    def cond(r: dict) -> str:
        need = " AND ".join(f"s_{s}" for s in r["all"])
        return need + (f" AND ({' OR '.join(f's_{s}' for s in r['any'])})" if r["any"] else "")

    rule = "CASE " + " ".join(f"WHEN {cond(r)} THEN '{n}'" for n, r in ordered) + " END"
    pick = lambda f, q: "CASE rule " + " ".join(f"WHEN '{n}' THEN {q}{r[f]}{q}" for n, r in ordered) + " END"
    dims: dict[str, list[str]] = {}
    for n, s in catalog["signals"].items():
        dims.setdefault(s["dimension"], []).append(n)
    n_dims = " + ".join(f"CASE WHEN {' OR '.join(f's_{s}' for s in g)} THEN 1 ELSE 0 END" for g in dims.values())
    chan = lambda f: "CASE channel " + " ".join(f"WHEN '{n}' THEN {'NULL' if c[f] is None else c[f]}" for n, c in catalog["channels"].items()) + " END"
    kept = f"idx_before IS NULL OR idx - idx_before > {chan('cooldown')} OR priority < priority_before"
    state = f"CASE WHEN {chan('quota')} IS NULL THEN 'on_panel' WHEN position <= {chan('quota')} THEN 'notified' ELSE 'waiting' END"
    return (
        f"SELECT *, {state} AS state FROM (SELECT *, row_number() OVER (PARTITION BY period, channel ORDER BY priority, compa ASC NULLS LAST, person_id) AS position FROM ("
        f"SELECT *, lag(idx) OVER (PARTITION BY person_id, channel ORDER BY idx) AS idx_before, lag(priority) OVER (PARTITION BY person_id, channel ORDER BY idx) AS priority_before FROM ("
        f"SELECT *, {pick('channel', chr(39))} AS channel, {pick('priority', '')} AS priority, {n_dims} AS dimensions FROM (SELECT *, {rule} AS rule FROM (SELECT *, {signals} FROM {table} WHERE {catalog['universe']}) s) r WHERE rule IS NOT NULL) c) p WHERE {kept}) k"
    )
