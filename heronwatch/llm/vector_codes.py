"""Vector code compression: each vector becomes a few code bytes by codebooks of its parts.

Components become integers floor(scale * x); a vector is cut into equal consecutive parts, and
each part position has a codebook of ``entries`` integer vectors. Rounds assign every part to its
nearest entry and move each entry to its parts' floored mean.

The nearest entry is found by equal averages. Entries are sorted by their component sum; from
where a part's own sum falls among them the search goes outwards, nearer sum first. By Cauchy and
Schwarz a squared distance is at least the squared gap of the sums over the dimension, so a part
stops once that bound strictly exceeds its best distance: equal distances are all seen, and the
lower index wins. Codebooks are the only thing sent to tasks; each task sends back one count and
one sum for each entry.

All arithmetic is exact: 64-bit where no square can overflow, Python's integers beyond. Errors
over the largest long are stored as the largest long. Left out are vectors that are null or empty,
hold a null or non-finite component, or cannot be cut as the others: those whose length is no
multiple of the number of parts, or not the length of the smallest such vec_id's. Null vec_ids come
last when the first entries are chosen, repeated ones are told by their vectors, and repeated rows
all count. With fewer vectors than entries the codebooks are that much shorter; an empty table
gives an empty result. Columns other than vec_id, embedding and label play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import pieces, released
from .storage import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Labels whose totals are sent to every task; more are joined by a shuffle.
MOST_LABELS = 100_000
LARGEST = (1 << 63) - 1
#: Sums travel as limbs of LIMB bits with the sign of the sum; as many as the largest double could need.
LIMB, LIMBS = 40, 32
SCHEMA = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each part's nearest entry of ``book``, ties to the lower index."""
    n, width = parts.shape
    sums = book.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    sums, last = sums[order], len(book) - 1
    own = parts.sum(axis=1)
    right = np.searchsorted(sums, own)
    left = right - 1
    index, best = np.full(n, -1), np.zeros(n, parts.dtype)
    rows = np.arange(n)
    while len(rows):
        lo, hi, at = left[rows], right[rows], own[rows]
        below, above = at - sums[np.maximum(lo, 0)], sums[np.minimum(hi, last)] - at
        down = (lo >= 0) & ((hi > last) | (below <= above))
        gap = np.where(down, below, above)
        live = ((lo >= 0) | (hi <= last)) & ((index[rows] < 0) | (gap * gap <= best[rows] * width))
        rows, down, lo, hi = rows[live], down[live], lo[live], hi[live]
        entry = order[np.where(down, lo, hi)]
        left[rows] -= down
        right[rows] += ~down
        gone = parts[rows] - book[entry]
        far = (gone * gone).sum(axis=1)
        old = index[rows]
        better = (old < 0) | (far < best[rows]) | ((far == best[rows]) & (entry < old))
        index[rows[better]], best[rows[better]] = entry[better], far[better]
    return index, best


def _matrix(column: pa.Array, width: int, scale: int, largest: int) -> np.ndarray:
    """The floored integers of the vectors, of Python's kind where squares could pass 64 bits;
    ``largest`` is that of the codebooks."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    top = max(int(np.abs(values).max(initial=0)) * scale + 1, largest)
    if (2 * top * width) ** 2 < 1 << 62:
        return np.floor(values * scale).astype(np.int64).reshape(-1, width)
    exact = [(int(x.numerator) * scale) // int(x.denominator) for x in map(_fraction, values)]
    return np.array(exact, dtype=object).reshape(-1, width)


def _fraction(x: float):
    from fractions import Fraction

    return Fraction(x)


def _books(books: list[list[list[int]]], like: np.ndarray) -> list[np.ndarray]:
    return [np.array(b, dtype=like.dtype) for b in books]


def _largest(books: list[list[list[int]]]) -> int:
    return max((abs(x) for b in books for e in b for x in e), default=0)


def usable(vectors: DataFrame, parts: int = PARTS) -> tuple[DataFrame, list[list[float]], int]:
    """(vec_id, embedding, label of the vectors that can be coded; the first ones; their length)."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    vector = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding"), F.col("label").cast("string").alias("label"))
    rows = materialize(rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0)).where(F.coalesce(finite, F.lit(False))))
    order = [F.col("vec_id").asc_nulls_last(), "embedding"]
    first = rows.orderBy(*order).first()
    width = len(first.embedding) if first else 0
    rows = rows.where(F.size("embedding") == width)
    starts = rows.orderBy(*order).limit(ENTRIES).collect() if first else []
    return rows, [r.embedding for r in starts], width


def _totals(rows: DataFrame, books: list[list[list[int]]], width: int, scale: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry): how many parts the entry is nearest to, and their sum by component."""
    parts, largest = len(books), _largest(books)
    step = width // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list[int]] = {}
        for batch in pieces(batches, 0):
            vectors = _matrix(batch.column(0), width, scale, largest)
            for p, book in enumerate(_books(books, vectors)):
                own = vectors[:, p * step : (p + 1) * step]
                index, _ = nearest(own, book)
                for e in np.unique(index):
                    mine = own[index == e]
                    now = [len(mine), *map(int, mine.sum(axis=0))]
                    old = found.get((p, int(e)))
                    found[p, int(e)] = now if old is None else [a + b for a, b in zip(old, now, strict=True)]
        keys, slots, limbs = [], [], []
        for (p, e), values in found.items():
            for i, v in enumerate(values):
                left, slot = abs(v), i * LIMBS
                while left:
                    keys.append(p * ENTRIES + e)
                    slots.append(slot)
                    limbs.append((left & ((1 << LIMB) - 1)) * (1 if v > 0 else -1))
                    left, slot = left >> LIMB, slot + 1
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(slots, pa.int32()), pa.array(limbs, pa.int64())], names=["key", "slot", "limb"])
        released()

    sums = rows.select("embedding").mapInArrow(run, "key int, slot int, limb long").groupBy("key", "slot").agg(F.sum(F.col("limb").cast("decimal(38,0)")).alias("limb"))
    out: dict[tuple[int, int], list[int]] = {}
    for r in sums.collect():  # parts x entries x components of the codebooks
        at = out.setdefault(divmod(r.key, ENTRIES), [0] * (step + 1))
        at[r.slot // LIMBS] += int(r.limb) << (LIMB * (r.slot % LIMBS))
    return {k: (v[0], v[1:]) for k, v in out.items()}


def codebooks(rows: DataFrame, starts: list[list[float]], width: int, parts: int = PARTS, rounds: int = ROUNDS, scale: int = SCALE) -> list[list[list[int]]]:
    """For each part position its entries, after ``rounds`` rounds over all ``rows``."""
    step = width // parts
    whole = [[(int(f.numerator) * scale) // int(f.denominator) for f in map(_fraction, v)] for v in starts]
    books = [[v[p * step : (p + 1) * step] for v in whole] for p in range(parts)]
    for _ in range(rounds):
        for (p, e), (n, sums) in _totals(rows, books, width, scale).items():
            books[p][e] = [s // n for s in sums]
    return books


def coded(rows: DataFrame, books: list[list[list[int]]], width: int, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code and error of every row."""
    parts, largest = len(books), _largest(books)
    step = width // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            vectors = _matrix(batch.column(1), width, scale, largest)
            index, error = np.zeros((len(vectors), parts), np.uint8), np.zeros(len(vectors), vectors.dtype)
            for p, book in enumerate(_books(books, vectors)):
                index[:, p], far = nearest(vectors[:, p * step : (p + 1) * step], book)
                error = error + far
            code = [x.tobytes().hex() for x in index]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(code, pa.string()), pa.array([min(int(x), LARGEST) for x in error], pa.int64())], names=["vec_id", "label", "code", "error"])
        released()

    return rows.select("vec_id", "embedding", "label").mapInArrow(run, "vec_id long, label string, code string, error long")


def decoded(rows: DataFrame, books: list[list[list[int]]], scale: int = SCALE) -> DataFrame:
    """``rows`` (with code) and the vector that each code stands for."""
    table = F.array(*[F.array(*[F.array(*[F.lit(float(x) / scale) for x in e]) for e in b]) for b in books])
    entry = F.transform(F.sequence(F.lit(0), F.lit(len(books) - 1)), lambda p: table[p][F.conv(F.substring("code", p * 2 + 1, 2), 16, 10).cast("int")])
    return rows.withColumn("decoded", F.flatten(entry))


def digest(books: list[list[list[int]]]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """Per usable row: vec_id, code, error, label_error, codebooks_sha256."""
    rows, starts, width = usable(vectors, parts)
    if not starts:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    books = codebooks(rows, starts, width, parts, rounds, scale)
    out = materialize(coded(rows, books, width, scale).withColumns({"bare": F.col("label").isNull(), "label": F.coalesce("label", F.lit(""))}))
    most = F.lit(LARGEST).cast("decimal(38,0)")
    totals = materialize(out.groupBy("bare", "label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error")))
    small = totals.limit(MOST_LABELS + 1).count() <= MOST_LABELS
    joined = out.join(F.broadcast(totals) if small else totals.hint("merge"), ["bare", "label"])
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The same by steps that SQL repeats: one table of codebooks for each round, all entries compared."""
    rank = "row_number() OVER (ORDER BY vec_id) - 1"
    steps = [
        f"kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings "
        f"WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0 AND len(embedding) % {PARTS} = 0)",
        f"cut AS (SELECT vec_id, label, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS w FROM kept, range({PARTS}) AS r(p))",
        f"book0 AS (SELECT p, e, w AS c FROM cut JOIN (SELECT vec_id, {rank} AS e FROM kept) USING (vec_id) WHERE e < {ENTRIES})",
    ]
    for r in range(ROUNDS + 1):
        steps.append(
            f"far{r} AS (SELECT vec_id, label, cut.p AS p, w, e, list_sum(list_transform(list_zip(w, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM cut JOIN book{r} USING (p))"
        )
        steps.append(f"near{r} AS (SELECT vec_id, label, p, w, e, d FROM far{r} QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1)")
        if r < ROUNDS:
            steps.append(f"wide{r} AS (SELECT p, e, i, sum(w[i]) AS s, count(*) AS n FROM near{r}, range(1, 1 + (SELECT max(len(w)) FROM cut)) AS t(i) GROUP BY ALL)")
            steps.append(f"mean{r} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM wide{r} GROUP BY p, e)")
            steps.append(f"book{r + 1} AS (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m ON m.p = b.p AND m.e = b.e)")
    steps.append(f"coded AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY vec_id)")
    steps.append(f"said AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})")
    return (
        "WITH " + ", ".join(steps) + " SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, said"
    )


SQL = _sql()
