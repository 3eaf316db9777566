"""Sets of word shingles: of texts in Arrow batches, and pairs of texts confirmed on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import pieces
from .hashing import U, lower_ascii, mix, text_buffers, word_bounds, word_hashes


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of every row, sorted by row and hash.

    A row with fewer words than a shingle has one: the whole sequence.
    """
    low = lower_ascii(data)
    start, end, row = word_bounds(low, offsets)
    h = word_hashes(low, start, end)
    n = len(h)
    rows = len(offsets) - 1
    counts = np.bincount(row, minlength=rows)
    parts_r, parts_h = [], []
    if n >= words:
        whole = row[: n - words + 1] == row[words - 1 :]
        s = np.zeros(n - words + 1, np.uint64)
        for k in range(words):
            s = s * U(0x9E3779B97F4A7C15) + h[k : k + len(s)]
        parts_r.append(row[: len(s)][whole])
        parts_h.append(mix(s[whole]))
    first = np.concatenate([[0], np.cumsum(counts)])
    for r in np.flatnonzero((counts > 0) & (counts < words)):
        s = U(counts[r])
        with np.errstate(over="ignore"):
            for x in h[first[r] : first[r + 1]]:
                s = s * U(0x9E3779B97F4A7C15) + x
        parts_r.append(np.array([r]))
        parts_h.append(mix(np.array([s])))
    if not parts_r:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row, sh = np.concatenate(parts_r), np.concatenate(parts_h)
    order = np.lexsort((sh, row))
    row, sh = row[order], sh[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (sh[1:] != sh[:-1])
    return row[new], sh[new]


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets are similar: 100 * |A & B| >= percent * |A | B|."""
    joined = (
        pairs.select("a", "b").hint("merge").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").hint("merge")
        .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            keep = np.zeros(batch.num_rows, bool)
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                sides = []
                for c in (2, 3):
                    data, offsets = text_buffers(part.column(c))
                    row, sh = shingle_sets(data, offsets, words)
                    sides.append((sh, np.searchsorted(row, np.arange(part.num_rows + 1))))
                for i in range(part.num_rows):
                    x, y = (s[at[i] : at[i + 1]] for s, at in sides)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[first + i] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    return joined.mapInArrow(run, "a long, b long")
