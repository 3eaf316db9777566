"""Substring dedup over words by difference-cover anchors.

Anchors are hashes of ``GRAM`` words at the positions whose remainder by ``PERIOD`` lies in a
difference cover: for any two positions some shift below the period puts both on the cover, so
two equal windows of 50 words share an aligned anchor wherever they begin. From the anchors the
match is extended to whole windows (see ``repeats``).

Null, empty and blank texts have no words and lose nothing; a very long text is one document;
repeated rows, null ids, empty tables and clashing names are as in ``repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import pieces
from .hashing import mix, prefix, ranges, text_buffers, word_bounds, word_hashes
from .repeats import Shape, cover_positions, doc_id, key_columns, keyed, marked, removed, spans
from .storage import shielded, unshielded

WINDOW = 50
#: A difference cover of the integers modulo 31.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
GRAM = WINDOW - PERIOD + 1
SHAPE = Shape(words=True, window=WINDOW, gram=GRAM, anchors=cover_positions(PERIOD, COVER))


def equal_windows(contents: list[bytes], n: np.ndarray) -> np.ndarray:
    """Class numbers of the windows of runs given by their words, one space between two."""
    data = np.frombuffer(b"".join(contents), np.uint8)
    start, end, row = word_bounds(data, np.cumsum([0, *map(len, contents)]))
    words = np.searchsorted(row, np.arange(len(contents)))
    n = n.astype(np.int64)
    first = np.repeat(words - np.cumsum(n) + n, n) + np.arange(n.sum())
    p = prefix(word_hashes(data, start, end))
    cls = np.unique(mix(ranges(p, first, first + WINDOW)), return_inverse=True)[1]
    # Windows of one hash are the same words.
    one = np.zeros(int(cls.max()) + 1 if len(cls) else 0, np.int64)
    one[cls] = np.arange(len(cls))
    x, y = first, first[one[cls]]
    raw, a, b, c, d = data.tobytes(), *(z.tolist() for z in (start[x], end[x + WINDOW - 1], start[y], end[y + WINDOW - 1]))
    if any(raw[i:j] != raw[k:m] for i, j, k, m in zip(a, b, c, d, strict=True)):
        ids: dict[bytes, int] = {}
        cls = np.array([ids.setdefault(raw[i:j], len(ids)) for i, j in zip(a, b, strict=True)])
    return cls


def _gone(batch: pa.RecordBatch, text: int) -> tuple[np.ndarray, ...]:
    """(bytes, start and end of each word, words' offsets by row, which words go); tag and spans
    are the last two columns."""
    data, offsets = text_buffers(batch.column(text))
    start, end, row = word_bounds(data, offsets)
    own = np.searchsorted(row, np.arange(batch.num_rows + 1))
    return data, start, end, own, removed(batch.column(batch.num_columns - 1), batch.column(batch.num_columns - 2), own, WINDOW)


def query(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            data, start, end, own, gone = _gone(batch, 1)
            kept, hashes = np.flatnonzero(~gone), []
            raw, at = data.tobytes(), np.searchsorted(kept, own)
            for x, y in zip(at[:-1], at[1:], strict=True):
                words = kept[x:y]
                hashes.append(hashlib.sha256(b" ".join([raw[s:e] for s, e in zip(start[words].tolist(), end[words].tolist(), strict=True)])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.diff(own)), pa.array(np.diff(own) - np.diff(at)), pa.array(hashes, pa.string())], names=["key", "tag", "n_words", "n_removed", "kept_sha256"])

    rows = marked(keyed(docs), SHAPE, equal_windows).select("key", "text", "tag", "spans")
    done = rows.mapInArrow(run, "key long, tag int, n_words long, n_removed long, kept_sha256 string")
    return done.select(doc_id(), "n_words", "n_removed", "kept_sha256")


def keep(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated words cut from the texts; documents left without a word go.

    A text that loses nothing stays as it is, white space included. In a cut text, each
    removed word takes the white space after it along. ``n_chars``, if there, is set anew.
    """
    found = spans(keyed(docs), SHAPE, equal_windows).groupBy("key").agg(F.collect_list(F.struct("tag", "at")).alias("spans"))
    own = shielded(docs, *key_columns(docs))
    joined = own.join(found, "key", "left").select(*[f"in_{i}" for i in range(len(docs.columns))], "tag", "spans")
    where, names = docs.columns.index("text"), docs.columns
    schema = shielded(docs).schema
    plain = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, where):
            data, start, _, words, gone = _gone(batch, where)
            offsets = text_buffers(batch.column(where))[1]
            # A word takes the white space after it along: up to the next word of the text, or its end.
            row = np.repeat(np.arange(batch.num_rows), np.diff(words))
            after = np.append(start[1:], 0)
            last = np.flatnonzero(np.diff(row, append=-1))
            after[last] = offsets[row[last] + 1]
            cut = np.bincount(row[gone], minlength=batch.num_rows) > 0
            texts = batch.column(where).to_pylist()
            for r in np.flatnonzero(cut):
                a, b = words[r], words[r + 1]
                stay = np.flatnonzero(~gone[a:b]) + a
                lead = data[offsets[r] : start[a]] if not gone[a] else data[:0]
                texts[r] = b"".join([lead.tobytes(), *(data[x:y].tobytes() for x, y in zip(start[stay].tolist(), after[stay].tolist(), strict=True))]).decode()
            left = ~cut | (np.bincount(row[~gone], minlength=batch.num_rows) > 0)
            columns = list(batch.columns[: len(names)])
            columns[where] = pa.array(texts, batch.schema.field(where).type)
            if "n_chars" in names:
                at = names.index("n_chars")
                columns[at] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=plain).filter(pa.array(left))

    return unshielded(joined.mapInArrow(run, schema), docs)
