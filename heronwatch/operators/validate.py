"""A contract applied to a source: every row is clean, rejected with one reason, or a repeat."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.normalize import NULL_TOKENS, STEPS, said, trimmed
from ..sources.contracts import Contract, ContractError, Field
from ..sources.tables import replace

MOST_REJECTED = 0.05


def _outside(c: Column, f: Field) -> Column:
    out = F.lit(False)
    if f.low is not None:
        out = out | (c < f.low)
    if f.high is not None:
        out = out | (c > f.high)
    return out


def reasons(name: str, f: Field) -> list[Column]:
    """Reasons to reject a row for one column, in the order they are looked at."""
    c = F.col(name)
    out = [F.when(c.isNull(), F.lit(f"{name}: missing"))] if f.required else []
    if f.pattern:
        out.append(F.when(~c.rlike(f.pattern), F.lit(f"{name}: pattern")))
    if f.domain:
        out.append(F.when(~c.isin(list(f.domain)), F.lit(f"{name}: domain")))
    if f.required and (f.low is not None or f.high is not None):
        out.append(F.when(_outside(c, f), F.lit(f"{name}: range")))
    if f.least_length:
        out.append(F.when(F.length(c) < f.least_length, F.lit(f"{name}: short")))
    return out


def bound(rows: DataFrame, cells: dict[str, Column]) -> DataFrame:
    """``rows`` with the columns ``cells`` worked out once a row: a generator of one row keeps
    the optimiser from copying an expression to each place that names it."""
    kept = [c for c in rows.columns if c not in cells]
    return rows.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in cells.items()]))))


def judged(conformed: DataFrame, contract: Contract) -> DataFrame:
    """Normalised cells, ``reject_reason`` (the first that holds) and ``_nulled``: the optional
    numbers that were out of range and became null."""
    out = bound(conformed, {n: trimmed(F.col(n)) for n in contract.fields})
    out = bound(out, {n: said(F.col(n)) for n in contract.fields})
    for k in range(max(len(STEPS[f.kind]) for f in contract.fields.values())):
        out = bound(out, {n: STEPS[f.kind][k](F.col(n)) if k < len(STEPS[f.kind]) else F.col(n) for n, f in contract.fields.items()})
    ranged = {n: f for n, f in contract.fields.items() if not f.required and (f.low is not None or f.high is not None)}
    nulled = F.array_compact(F.array(*[F.when(_outside(F.col(n), f), F.lit(n)) for n, f in ranged.items()])) if ranged else F.array().cast("array<string>")
    every = [r for n, f in contract.fields.items() for r in reasons(n, f)]
    out = out.withColumn("_nulled", nulled).withColumn("reject_reason", F.coalesce(*every))
    return out.withColumns({n: F.when(~_outside(F.col(n), f), F.col(n)) for n, f in ranged.items()})


def split_and_write(rows: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """``judged`` rows as two tables, written side by side in one pass and read back: clean ones
    without a reason, rejected ones with it."""
    replace(rows.withColumn("rejected", F.col("reject_reason").isNotNull()), folder, "rejected")
    return _sides(rows, folder)


def _sides(rows: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    found = rows.withColumn("rejected", F.lit(False))
    found = rows.sparkSession.read.schema(found.schema).parquet(folder)  # a filter on rejected reads its side only
    return found.where("NOT rejected").drop("rejected", "reject_reason"), found.where("rejected").drop("rejected")


def deduplicated(clean: DataFrame, contract: Contract, row: str = "_row") -> DataFrame:
    """``repeat``: whether an earlier row of the file has the same key."""
    w = Window.partitionBy(*contract.key).orderBy(row)
    return clean.withColumn("repeat", F.row_number().over(w) > 1)


def summary(rows: DataFrame, contract: Contract) -> DataFrame:
    """One row: source, rows_in, valid, rejected, repeats, reject_rate, from ``judged`` rows, which
    are read once: of the clean rows of a key the first is valid, the others are repeats."""
    by_key = rows.groupBy(*contract.key).agg(F.count("*").alias("n"), F.count("reject_reason").alias("bad"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    one = by_key.agg(total("n").alias("rows_in"), total(F.when(F.col("n") > F.col("bad"), 1).otherwise(0)).alias("valid"), total("bad").alias("rejected"))
    repeats, rate = F.col("rows_in") - F.col("rejected") - F.col("valid"), F.try_divide(F.col("rejected").cast("double"), F.col("rows_in").cast("double"))
    return one.select(F.lit(contract.name).alias("source"), "rows_in", "valid", "rejected", repeats.alias("repeats"), rate.alias("reject_rate"))


def incidents(rows: DataFrame, conformed: DataFrame, contract: Contract) -> DataFrame:
    """type, column, rows: reject reasons (first ones), optional nulls and cells made null."""
    rejected = rows.where("reject_reason IS NOT NULL").groupBy(F.col("reject_reason").alias("r")).agg(F.count("*").alias("rows"))
    rejected = rejected.select(F.split_part("r", F.lit(": "), F.lit(2)).alias("type"), F.split_part("r", F.lit(": "), F.lit(1)).alias("column"), "rows")
    optional = [n for n, f in contract.fields.items() if not f.required]
    one = rows.agg(*[F.sum(F.when(F.col(n).isNull() & ~F.array_contains("_nulled", n), 1).otherwise(0)).alias(f"e_{n}") for n in optional], *[F.sum(F.array_contains("_nulled", n).cast("long")).alias(f"o_{n}") for n in optional])
    lines = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(n).alias("column"), F.col(f"{p}_{n}").alias("rows")) for n in optional for p, t in (("e", "optional_null"), ("o", "made_null"))])
    return rejected.unionByName(one.select(F.explode(lines).alias("x")).select("x.*").where("rows > 0"))


def repairs(conformed: DataFrame, contract: Contract) -> DataFrame:
    """Silent repairs by column: stray_spaces, written_nulls (with up to 4 examples), decimal_commas, period_shapes."""
    cols = list(contract.fields)
    trim = lambda c: F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    one = conformed.agg(*[
        F.struct(
            F.lit(c).alias("column"), n(trim(F.col(c)) != F.col(c)).alias("stray_spaces"), n(trim(F.col(c)).isin(NULL_TOKENS)).alias("written_nulls"),
            F.slice(F.array_sort(F.collect_set(F.when(trim(F.col(c)).isin(NULL_TOKENS), trim(F.col(c))))), 1, 4).alias("examples"),
            n(F.lit(contract.fields[c].kind in ("number", "integer")) & F.contains(F.col(c), F.lit(","))).alias("decimal_commas"),
            n(F.lit(contract.fields[c].kind == "period") & ~trim(F.col(c)).rlike("^[0-9]{4}-[0-9]{2}$")).alias("period_shapes"),
        ).alias(c) for c in cols
    ])
    return one.select(F.explode(F.array(*cols)).alias("x")).select("x.*")


def stop_if_bad(rows: DataFrame, contract: Contract, most: float = MOST_REJECTED) -> None:
    """Raises with the three most frequent reasons if too many rows are rejected."""
    n, bad = rows.agg(F.count("*"), F.count("reject_reason")).first()
    if n and bad / n > most:
        top = rows.where("reject_reason IS NOT NULL").groupBy("reject_reason").count().orderBy(F.desc("count"), "reject_reason").limit(3).collect()
        raise ContractError(f"{contract.name}: {bad} of {n} rows rejected; " + ", ".join(f"{r[0]} ({r[1]})" for r in top))


@dataclass(frozen=True)
class Landed:
    """A source after its one pass: its two tables, and what was counted on the way."""

    source: str
    clean: DataFrame
    quarantine: DataFrame
    counts: dict[tuple[str, str, str], int]  # (kind, column, detail): rows

    def report(self) -> DataFrame:
        """source, kind, column, detail, rows of all counts that are not 0, and of the totals."""
        rows = [(self.source, *k, n) for k, n in self.counts.items() if n or k[0] in ("rows_in", "rejected")]
        return self.clean.sparkSession.createDataFrame(rows, "source string, kind string, column string, detail string, rows long")


def _watched(contract: Contract) -> tuple[dict[tuple[str, str, str], Column], dict[tuple[str, str, str], Column]]:
    """What is counted of the cells as written, and of the rows once judged."""
    raw: dict[tuple[str, str, str], Column] = {}
    done: dict[tuple[str, str, str], Column] = {("rows_in", "", ""): F.lit(True), ("rejected", "", ""): F.col("reject_reason").isNotNull()}
    for n, f in contract.fields.items():
        trimmed = F.regexp_replace(n, "(?U)^\\s+|\\s+$", "")
        raw[("stray_spaces", n, "")] = trimmed != F.col(n)
        raw |= {("written_null", n, t): trimmed == t for t in NULL_TOKENS}
        if f.kind in ("number", "integer"):
            raw[("decimal_comma", n, "")] = F.contains(F.col(n), F.lit(","))
        if f.kind == "period":
            raw[("period_shape", n, "")] = ~trimmed.rlike("^[0-9]{4}-[0-9]{2}$")
        done |= {("reject", n, kind): F.col("reject_reason") == f"{n}: {kind}" for kind in ("missing", "pattern", "domain", "range", "short")}
        if not f.required:
            done[("optional_null", n, "")] = F.col(n).isNull() & ~F.array_contains("_nulled", n)
            done[("made_null", n, "")] = F.array_contains("_nulled", n)
    return raw, done


def land(conformed: DataFrame, contract: Contract, folder: str, most: float = MOST_REJECTED) -> Landed:
    """One pass over a source: judged, split into clean and quarantine (written side by side), and
    counted while it is written. The gate is raised from those counts, after the quarantine is
    there to look at: clean rows of a source that is rejected must not be read."""
    raw, done = _watched(contract)
    counted = lambda what: [F.count_if(c).alias(str(i)) for i, c in enumerate(what.values())]
    first, second = Observation(), Observation()
    rows = judged(conformed.observe(first, *counted(raw)), contract).observe(second, *counted(done))
    replace(rows.withColumn("rejected", F.col("reject_reason").isNotNull()), folder, "rejected")
    counts = {k: seen.get[str(i)] for what, seen in ((raw, first), (done, second)) for i, k in enumerate(what)}
    n, bad = counts["rows_in", "", ""], counts["rejected", "", ""]
    if n and bad / n > most:
        top = sorted(((-m, f"{c}: {kind}") for (what, c, kind), m in counts.items() if what == "reject" and m))[:3]
        raise ContractError(f"{contract.name}: {bad} of {n} rows rejected; " + ", ".join(f"{r} ({-m})" for m, r in top))
    return Landed(contract.name, *_sides(rows, folder), counts)


def orphans(rows: DataFrame, directory: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose id the directory has, the others)."""
    known = directory.select(key).distinct()
    return rows.join(known, key, "left_semi"), rows.join(known, key, "left_anti")


def unmapped(directory: DataFrame, dimension: DataFrame, on: list[str]) -> DataFrame:
    """Combinations of the directory that the dimension lacks."""
    return directory.select(*on).distinct().join(dimension.select(*on).distinct(), on, "left_anti")


def stop_if_unmapped(directory: DataFrame, dimension: DataFrame, on: list[str]) -> None:
    if some := unmapped(directory, dimension, on).limit(5).collect():
        raise ContractError(f"not in the dimension: {[tuple(r) for r in some]}")

