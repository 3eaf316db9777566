"""A set of 64-bit keys as bits of a fixed number: sent to every task whatever the set's size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import released
from .hashing import U, mix

#: Two bits of this many are set for each key: 8 MB.
BITS, CHUNK_BITS = 26, 20
_SIZE = U((1 << BITS) - 1)


def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mix(keys.view(np.uint64))
    return h & _SIZE, (h >> U(BITS)) & _SIZE


class Filter:
    """May say that it has a key that it was not given, never that it lacks one that it was."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def has(self, keys: np.ndarray) -> np.ndarray:
        a, b = _places(keys)
        one = lambda x: self.bits[x >> U(3)] >> (x & U(7)).astype(np.uint8)
        return (one(a) & one(b) & 1).astype(bool)

    def __or__(self, other: Filter) -> Filter:
        return Filter(self.bits | other.bits)

    @staticmethod
    def of(keys: DataFrame) -> Filter:
        """The filter of a table of one long column. Each chunk of its bits is made in one place,
        from keys that hashing deals out evenly; the driver sees the bits only."""
        width = 1 << (CHUNK_BITS - 3)

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                place = np.concatenate(_places(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((place >> CHUNK_BITS).astype(np.int32)), pa.array((place & ((1 << CHUNK_BITS) - 1)).astype(np.int32))], names=["chunk", "place"])
            released()

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, np.ndarray] = {}
            for batch in batches:
                chunk, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                for c in np.unique(chunk):
                    found.setdefault(int(c), np.zeros(1 << CHUNK_BITS, bool))[place[chunk == c]] = True
            bits = [np.packbits(v, bitorder="little").tobytes() for v in found.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(bits, pa.binary())], names=["chunk", "bits"])
            released()

        out = np.zeros(1 << (BITS - 3), np.uint8)
        places = keys.mapInArrow(dealt, "chunk int, place int").repartition("chunk")
        for r in places.mapInArrow(packed, "chunk int, bits binary").collect():  # of a fixed size
            out[r.chunk * width : (r.chunk + 1) * width] = np.frombuffer(r.bits, np.uint8)
        return Filter(out)


def kept(rows: DataFrame, column: str, known: Filter) -> DataFrame:
    """The ``rows`` whose long ``column`` the filter has: those of the set, and a few others."""
    sent, at = rows.sparkSession.sparkContext.broadcast(known.bits), rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = Filter(sent.value)
        for batch in batches:
            own = batch.column(at)
            mask = have.has(own.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            yield batch.filter(pa.array(mask))
        released()

    return rows.mapInArrow(run, rows.schema)
