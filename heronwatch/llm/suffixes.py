"""Exact byte dedup by a hash-compared suffix sort.

Anchors narrow the corpus to the parts that can repeat; the suffixes that start there are
sorted. Prefix polynomial hashes give the longest common extension of two suffixes by binary
search, so a comparison in the mergesort takes logarithmic time; suffixes that share their
first eight bytes are merged that way, the rest by those bytes. A suffix whose 50 bytes have a
hash that no other has is equal to none and is not sorted, and suffixes that share their first
bytes and that hash alike need no merging. Neighbours in the sorted order that agree on 50 bytes
by hash are verified byte by byte.

Null and empty texts have no bytes and lose nothing; a very long text is one document; repeated
rows, null ids, empty tables and clashing names are as in ``repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import pieces
from .hashing import BYTE_VALUES, INVERSE, powers, prefix, text_buffers
from .repeats import Shape, doc_id, keyed, marked, removed, smallest_grams

WINDOW = 50
SHAPE = Shape(words=False, window=WINDOW, gram=16, anchors=smallest_grams, grams_are_anchors=True)


class Suffixes:
    """Suffixes of a buffer, compared over ``depth`` bytes."""

    def __init__(self, data: np.ndarray, depth: int):
        self.data, self.depth = data, depth
        self.p = prefix(BYTE_VALUES[data])
        self.inverse = powers(INVERSE, len(self.p))

    def hashes(self, x: np.ndarray) -> np.ndarray:
        """Hashes of the first ``depth`` bytes of suffixes."""
        return (self.p[x + self.depth] - self.p[x]) * self.inverse[x]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of suffixes ``x`` and ``y``, up to depth."""
        low = np.zeros(len(x), np.int64)
        step = 1 << (self.depth.bit_length() - 1)
        ix, iy, px, py = self.inverse[x], self.inverse[y], self.p[x], self.p[y]
        while step:
            to = low + step
            fits = to <= self.depth
            e = np.where(fits, to, 0)
            same = fits & ((self.p[x + e] - px) * ix == (self.p[y + e] - py) * iy)
            low = np.where(same, to, low)
            step >>= 1
        return low

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether suffix ``x`` is smaller than ``y`` within the depth."""
        n = self.common(x, y)
        at = np.minimum(n, self.depth - 1)
        return (n < self.depth) & (self.data[x + at] < self.data[y + at])

    def sorted(self, start: np.ndarray) -> np.ndarray:
        """Order of the suffixes at ``start``; each has ``depth`` bytes at least."""
        lead = np.zeros(len(start), np.uint64)
        for k in range(8):
            lead = (lead << np.uint64(8)) | self.data[start + k]
        order = np.argsort(lead, kind="stable")
        lead = lead[order]
        new = np.ones(len(order), bool)
        new[1:] = lead[1:] != lead[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(order)))
        h = self.hashes(start)[order]
        # Segments of suffixes with one hash are in order already.
        mixed = np.minimum.reduceat(h, first) != np.maximum.reduceat(h, first) if len(first) else np.zeros(0, bool)
        seg = np.repeat(first, size)  # first place of the own segment
        end = np.repeat(np.where(mixed, first + size, first), size)
        width = 1
        longest = int(size[mixed].max()) if mixed.any() else 0
        while width < longest:
            act = np.flatnonzero(end - seg > width)
            r = act - seg[act]
            left = (r // width) % 2 == 0
            base = seg[act] + (r // (2 * width)) * 2 * width
            lo = np.where(left, np.minimum(base + width, end[act]), base)
            hi = np.where(left, np.minimum(base + 2 * width, end[act]), np.minimum(base + width, end[act]))
            begin = lo.copy()
            own = start[order[act]]
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) // 2
                other = start[order[mid]]
                # Left elements go before equal right ones.
                after = np.where(left[open_], self.less(other, own[open_]), ~self.less(own[open_], other))
                lo[open_] = np.where(after, mid + 1, lo[open_])
                hi[open_] = np.where(after, hi[open_], mid)
            inner = r % width
            placed = order.copy()
            placed[base + inner + (lo - begin)] = order[act]
            order = placed
            width *= 2
        return order

    def verified(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k in range(self.depth):
            out &= self.data[x + k] == self.data[y + k]
        return out


def equal_windows(contents: list[bytes], n: np.ndarray) -> np.ndarray:
    """Class numbers of the windows of runs given by their bytes."""
    data = np.frombuffer(b"".join(contents), np.uint8)
    lens = n.astype(np.int64) + WINDOW - 1
    start = np.repeat(np.cumsum(lens) - lens - np.cumsum(n) + n, n) + np.arange(n.sum())
    s = Suffixes(data, WINDOW)
    h = s.hashes(start)
    _, back, times = np.unique(h, return_inverse=True, return_counts=True)
    several = np.flatnonzero(times[back] > 1)  # a hash that no other window has is equal to none
    order = several[s.sorted(start[several])]
    x, y = start[order[:-1]], start[order[1:]]
    same = h[order[:-1]] == h[order[1:]]
    near = np.flatnonzero(same)
    if not s.verified(x[near], y[near]).all():  # two texts with one hash: compare the bytes themselves
        raw = data.tobytes()
        return np.unique(np.array([raw[i : i + WINDOW] for i in start.tolist()], object), return_inverse=True)[1]
    cls = np.arange(len(start), dtype=np.int64)
    if len(order):
        cls[order] = len(start) + np.concatenate([[0], np.cumsum(~same)])
    return cls


def query(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            data, own = text_buffers(batch.column(2))
            gone = removed(batch.column(3), batch.column(1), own, WINDOW)
            sums = np.concatenate([[0], np.cumsum(gone)])
            first = gone.copy()
            first[1:] &= ~gone[:-1]
            edges = own[:-1][own[:-1] < len(gone)]
            first[edges] = gone[edges]  # a run does not reach over the end of a text
            spans = np.concatenate([[0], np.cumsum(first)])
            kept, at = data[~gone].tobytes(), own - sums[own]
            hashes = [hashlib.sha256(kept[x:y]).hexdigest() for x, y in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *(pa.array(np.diff(x).astype(np.int64)) for x in (own, sums[own], spans[own])), pa.array(hashes, pa.string())],
                names=["key", "tag", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    done = marked(keyed(docs), SHAPE, equal_windows).mapInArrow(run, "key long, tag int, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return done.select(doc_id(), "n_bytes", "n_removed", "n_spans", "kept_sha256")
