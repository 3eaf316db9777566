"""Byte-level BPE encoding and decoding with the ``tokenizers`` library over Arrow batches.

A text is split by the published pattern; every distinct piece of a batch is encoded once by
the library (bytes mapped to printable characters, merged by rank) and its ids are kept in a
bounded table (by pieces and by their characters), so frequent pieces cost one lookup. Decoding
reverses the byte table: ids give printable stand-ins, those give bytes, and bytes give text, so
characters that were split over several ids come back whole. Offsets say which characters each id
covers; a split character belongs to all its ids.

Nulls count as empty texts and give no ids; empty tables give none. A very long text is
encoded as a whole, alone in its piece of a batch. Rows that repeat are coded alike. Columns of
the input may have any name; one that is named like a new column is replaced. No shuffle takes
place.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import pieces

#: Pieces, and their characters, kept per worker before the table starts anew.
KEPT_PIECES, KEPT_CHARACTERS = 200_000, 4_000_000
_coders: dict[tuple[str, str], Coder] = {}


def byte_characters() -> dict[int, str]:
    """The printable stand-in of each byte value: itself where printable, else 256 upwards."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(extra)
            extra += 1
    return table


class Coder:
    """Encoder and decoder for one rank file; built once per worker."""

    def __init__(self, ranks_path: str, pattern: str):
        from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        chars = byte_characters()
        name = lambda token: "".join(map(chars.__getitem__, token))
        merges = []
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                merges.append(self._parents(token, rank, ranks))
        self.names = {rank: name(token) for token, rank in ranks.items()}
        self.bytes_of = np.zeros(max(map(ord, chars.values())) + 1, np.uint8)  # the byte table, reversed
        for byte, char in chars.items():
            self.bytes_of[ord(char)] = byte
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.lengths[list(ranks.values())] = [len(t) for t in ranks]
        self.library = Tokenizer(
            models.BPE(vocab={name(t): r for t, r in ranks.items()}, merges=[(name(a), name(b)) for a, b in merges], ignore_merges=True)
        )
        self.library.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.pieces = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.whole = Tokenizer(self.library.model)
        self.whole.pre_tokenizer = self.pieces
        self.library.decoder = self.whole.decoder = decoders.ByteLevel()
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.held = 0

    @staticmethod
    def _parents(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
        """The two parts that merge into ``token``: what is left after all earlier merges."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60) if parts[i] + parts[i + 1] != token else 1 << 60)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts[0], parts[1]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        pieces, known = self.split(text), self.known
        try:
            return b"".join(map(known.__getitem__, pieces))
        except KeyError:
            pass
        if len(known) > KEPT_PIECES or self.held > KEPT_CHARACTERS:
            known.clear()
            self.held = 0
        new = [p for p in dict.fromkeys(pieces) if p not in known]
        coded = self.whole.encode(new, is_pretokenized=True, add_special_tokens=False)
        ids, words = np.array(coded.ids, dtype="<u4").tobytes(), np.array(coded.word_ids)
        ends = (4 * np.searchsorted(words, np.arange(len(new)), "right")).tolist()
        start = 0
        for piece, end in zip(new, ends, strict=True):
            known[piece] = ids[start:end]
            self.held += len(piece)
            start = end
        return b"".join(map(known.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        """Bytes of little-endian ids: their stand-ins through the reversed byte table."""
        printed = "".join(map(self.names.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids)))
        return self.bytes_of[np.frombuffer(printed.encode("utf-16-le"), np.uint16)].tobytes()

    def offsets(self, ids: bytes, text: bytes) -> np.ndarray:
        """(start, end) of the characters that each id covers, of a UTF-8 text and its ids."""
        end = np.cumsum(self.lengths[np.frombuffer(ids, "<u4")])
        if not len(end):
            return np.zeros((0, 2), "<u4")
        character = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80) - 1  # of each byte
        start = np.concatenate([[0], end[:-1]])
        return np.stack([character[start], character[end - 1] + 1], axis=1).astype("<u4")


def _lists(coded: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(c) // 4 for c in coded)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), "<i4")))


def coder(ranks_path: str, pattern: str) -> Coder:
    if (ranks_path, pattern) not in _coders:
        _coders[ranks_path, pattern] = Coder(ranks_path, pattern)
    return _coders[ranks_path, pattern]


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, text: str = "text", ids: str = "token_ids", offsets: str | None = None) -> DataFrame:
    """Every row of ``docs`` with its ids (and, if named, the characters of each id).

    Columns of ``docs`` with the new names are replaced.
    """
    new = [n for n in (ids, offsets) if n]
    kept = docs.drop(*new)
    if text not in kept.columns:
        raise ValueError(f"no column {text}")
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)]
    if offsets:
        pair = T.StructType([T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False)])
        fields.append(T.StructField(offsets, T.ArrayType(pair, False), False))
    where = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks_path, pattern)
        for batch in pieces(batches, where):
            texts = [t or "" for t in batch.column(where).to_pylist()]
            coded = [own.encode(t) for t in texts]
            columns = [_lists(coded)]
            if offsets:
                spans = np.concatenate([np.zeros((0, 2), "<u4"), *(own.offsets(c, t.encode()) for c, t in zip(coded, texts, strict=True))]).astype(np.int32)
                pair = pa.StructArray.from_arrays([pa.array(spans[:, 0]), pa.array(spans[:, 1])], ["start", "end"])
                columns.append(pa.ListArray.from_arrays(columns[0].offsets, pair))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *new])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *fields]))


def decode(coded: DataFrame, ranks_path: str, pattern: str, *, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """Every row with its ids as text; bytes that are no UTF-8 become the replacement character."""
    kept = coded.drop(text)
    where = kept.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks_path, pattern)
        for batch in pieces(batches, where):
            texts = [own.decode(np.array(x or (), "<u4").tobytes()).decode("utf-8", "replace") for x in batch.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(text, T.StringType(), False)]))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids and whether decoding gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks_path, pattern)
        for batch in pieces(batches, 3):
            texts = [t or "" for t in batch.column(3).to_pylist()]
            coded = [own.encode(t) for t in texts]
            same = [own.decode(c) == t.encode() for c, t in zip(coded, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([len(c) // 4 for c in coded], pa.int64()), _lists(coded), pa.array(same, pa.bool_())],
                names=["doc_id", "lang", "source", "n_tokens", "token_ids", "decoded_same"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")])
    return source.mapInArrow(run, "doc_id long, lang string, source string, n_tokens long, token_ids array<int>, decoded_same boolean")


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document: n_tokens, SHA-256 of the ids, of the bytes decoded from them and of the
    offsets (pairs of unsigned 32-bit integers), and the number of characters that several ids share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks_path, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in pieces(batches, 1):
            rows: tuple[list, ...] = [], [], [], [], []
            for t in batch.column(1).to_pylist():
                text = (t or "").encode()
                ids = own.encode(t or "")
                spans = own.offsets(ids, text)
                split = np.unique(spans[1:, 0][spans[1:, 0] < spans[:-1, 1]])
                for column, x in zip(rows, (len(ids) // 4, sha(ids), sha(own.decode(ids)), sha(spans.tobytes()), len(split)), strict=True):
                    column.append(x)
            kinds = pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, k) for x, k in zip(rows, kinds, strict=True))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "offsets_sha256", "n_split"]
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, offsets_sha256 string, n_split long")
