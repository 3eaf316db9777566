"""Arrow batches in pieces of bounded size, and memory given back between tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .hashing import chunks, text_buffers

#: Bytes of the widest column of a piece, unless one row has more.
PIECE_BYTES = 4 << 20


def released() -> None:
    """Hand free memory back to the system: a worker that waits for its next task keeps little."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        return


def _offsets(column: pa.Array) -> np.ndarray:
    if pa.types.is_list(column.type):
        at = column.offsets.to_numpy().astype(np.int64)
        return (at - at[0]) * 4
    return text_buffers(column)[1]


def pieces(batches: Iterator[pa.RecordBatch], column: int | str, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut where ``column`` (texts, or lists of 32-bit numbers) adds up to ``size``
    bytes; one row at least."""
    for batch in batches:
        for a, b in chunks(_offsets(batch.column(column)), size):
            yield batch.slice(a, b - a)
    released()
