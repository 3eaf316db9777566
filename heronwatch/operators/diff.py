"""Two tables compared cell by cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import staged

#: Buckets of keys that two tables are folded to before they are compared; as many ids are sent to every task.
BUCKETS = 65_536


class TablesDiffer(ValueError):
    """The tables can't be compared: columns or row counts differ."""


def check_shape(a: DataFrame, b: DataFrame) -> None:
    if set(a.columns) != set(b.columns):
        raise TablesDiffer(f"columns in one table only: {sorted(set(a.columns) ^ set(b.columns))}")
    if (n := a.count()) != (m := b.count()):
        raise TablesDiffer(f"{n} and {m} rows")


def equal(a: Column, b: Column, kind: str, tolerance: float) -> Column:
    if kind in ("double", "float"):
        near = F.abs(a - b) <= tolerance + tolerance * F.abs(b)
        return a.eqNullSafe(b) | F.coalesce(near, F.lit(False))
    return a.eqNullSafe(b)


def digests(rows: DataFrame, key: list[str], cols: list[str], buckets: int) -> DataFrame:
    """bucket, n, total, parity: the rows whose key falls into a bucket, folded to a count, the sum
    of one hash and the xor of another. Equal tables have equal digests, whatever their order."""
    every = [*key, *cols]
    one, two = F.xxhash64(*every), F.xxhash64(F.lit("parity"), *reversed(every))
    return rows.groupBy(bucket_of(key, buckets).alias("bucket")).agg(F.count("*").alias("n"), F.sum(one.cast("decimal(38,0)")).alias("total"), F.bit_xor(two).alias("parity"))


def bucket_of(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def unequal_buckets(a: DataFrame, b: DataFrame, key: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The buckets of keys whose rows are not the same in both tables: at most ``buckets`` rows."""
    cols = [c for c in a.columns if c not in key]
    both = digests(a, key, cols, buckets).alias("a").join(digests(b, key, cols, buckets).alias("b"), "bucket", "full")
    same = F.lit(True)
    for c in ("n", "total", "parity"):
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return both.where(~same).select("bucket")


def local_cell_diff(a: DataFrame, b: DataFrame, key: list[str], tolerance: float = 1e-9, buckets: int = BUCKETS) -> DataFrame:
    """``cell_diff`` of tables that mostly agree: both are folded to digests first, and only rows of
    unequal buckets are sent and joined, so the shuffle follows what differs. Digests are exact:
    a difference within the tolerance makes a bucket unequal, and is then judged cell by cell."""
    unequal = staged(unequal_buckets(a, b, key, buckets))
    only = lambda t: t.join(F.broadcast(unequal), bucket_of(key, buckets) == F.col("bucket"), "left_semi")
    return cell_diff(only(a), only(b.select(*a.columns)), key, tolerance)


def cell_diff(a: DataFrame, b: DataFrame, key: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Per column: rows that differ and the widest numeric gap. Nulls are equal, lists compare by
    value. Rows with one whole-row hash on both sides are equal and meet no further work."""
    cols = [c for c in a.columns if c not in key]
    kinds = dict(a.dtypes)
    both = a.select(*key, F.struct(*cols).alias("a"), F.xxhash64(*cols).alias("_ha")).join(b.select(*key, F.struct(*cols).alias("b"), F.xxhash64(*cols).alias("_hb")), key, "full")
    both = both.where(~F.col("_ha").eqNullSafe(F.col("_hb")) | F.col("a").isNull() | F.col("b").isNull())
    numeric = lambda c: kinds[c] in ("double", "float", "int", "bigint")
    one = both.agg(*[
        F.struct(
            F.lit(c).alias("column"),
            F.coalesce(F.sum(F.when(F.col("a").isNull() | F.col("b").isNull() | ~equal(F.col(f"a.{c}"), F.col(f"b.{c}"), kinds[c], tolerance), 1).otherwise(0)), F.lit(0)).alias("differ"),
            (F.max(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}"))).cast("double") if numeric(c) else F.lit(None).cast("double")).alias("widest"),
        ).alias(c) for c in cols
    ])
    return one.select(F.explode(F.array(*cols)).alias("x")).select("x.*")
