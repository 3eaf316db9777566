"""Vectorised hashing of text held in Arrow batches.

A prefix polynomial over 64-bit wrap-around arithmetic gives the hash of any range in
constant time: ``P[i] = sum(v[j] * M**j for j < i)`` and the hash of ``[s, e)`` is
``(P[e] - P[s]) * M**-s``. ``M`` is odd, so its inverse exists. Work runs over chunks of a
few hundred kilobytes, so memory stays flat whatever the size of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
MULT = 0x9E3779B97F4A7C15
INVERSE = pow(MULT, -1, 1 << 64)
#: One pseudo-random 64-bit value per byte value.
BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** [0, n)`` modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16) + (n >> 2), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix polynomial of 64-bit values; one longer than the input."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(MULT, len(values)), out=out[1:])
    return out


def ranges(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges ``[start, end)`` from a prefix polynomial."""
    return (p[end] - p[start]) * powers(INVERSE, len(p))[start]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, size: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; one row at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; all other bytes stay."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of bytes ``inside`` words: by default those other
    than space and 0x09-0x0D."""
    if inside is None:
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = np.unique(offsets)
    at = edges[edges < len(data)]
    first[at] = inside[at]
    at = edges[edges > 0] - 1
    last[at] = inside[at]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    return mix(ranges(prefix(BYTE_VALUES[data]), start, end) + (end - start).astype(np.uint64))


def slide(a: np.ndarray, w: int, pick) -> np.ndarray:
    """``pick`` (a binary ufunc) over every window of ``w`` entries."""
    span = 1
    while span * 2 <= w:
        a = pick(a[:-span], a[span:])
        span *= 2
    return pick(a[: len(a) - (w - span)], a[w - span :]) if w > span else a


def opened(h: np.ndarray, w: int) -> np.ndarray:
    """Mask of the positions that hold the minimum of some window of ``w`` entries."""
    if len(h) < w:
        return np.zeros(len(h), bool)
    pad = np.zeros(w - 1, np.uint64)
    return slide(np.concatenate([pad, slide(h, w, np.minimum), pad]), w, np.maximum) == h
