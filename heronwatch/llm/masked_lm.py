"""Language-model scores by masked pseudo-likelihood.

A window network predicts each word from the ``REACH`` words before and after it: embeddings of
the neighbours, scaled by position, are added up and rectified. Two softmax layers follow: one
gives the word's group, the other the word within the group. The ``KNOWN`` most frequent words
are in groups of ``GROUP`` of like frequency; every rarer word is in the group of its length,
and there follows the corpus: its share of all words of that group. The score of a document is
the sum of the log-probabilities of all its words, each given both sides.

What is gathered grows with the corpus: counts cover every word of every document, stay a
table, and meet the rare words of the documents in a join. Training covers every position of
every document: in each of ``ROUNDS`` rounds a hash masks another part of them, and the rounds
have all; each task takes gradient steps over its own and hands on the weights it moved, and
averages by trained words, in two steps, start the next round. The driver holds the model and the known words, of fixed size.

Words are maximal runs of bytes outside ASCII white space, lower-cased in A-Z. Null, empty and
blank texts have no words, the sum 0 and a null mean; very long texts count whole; rows that
repeat score alike; an empty table gives none; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import pieces
from .hashing import U, chunks, lower_ascii, mix, text_buffers, word_bounds, word_hashes
from .storage import materialize

REACH = 3
HIDDEN = 16
KNOWN, GROUP = 4_096, 64
GROUPS, LENGTHS = KNOWN // GROUP, 8
#: Kinds of words to the network: known ones, lengths of others, and no word.
KINDS = KNOWN + LENGTHS + 1
#: Every position is trained in one of so many rounds.
ROUNDS = 2
BATCH = 16_384
RATE = 0.08
#: Logits of a batch that differ by less are shifted alike.
SPAN = 60
#: Tasks whose weights meet in one task, about, before all meet.
BINS = 256


@dataclass
class Vocabulary:
    hashes: np.ndarray  # of the known words, sorted
    kinds: np.ndarray  # rank of each by frequency
    group_prior: np.ndarray  # log-probability of each group
    inner_prior: np.ndarray  # log-probability of each word of each group
    rare: np.ndarray  # occurrences of all rarer words, by length group

    def look_up(self, h: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Kind of the words given by hash and byte length."""
        kind = KNOWN + length_group(length)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            kind = np.where(self.hashes[at] == h, self.kinds[at], kind)
        return kind


def length_group(length: np.ndarray) -> np.ndarray:
    return np.minimum(length, LENGTHS * 2 - 1) // 2


def words_in(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, byte length, row) of the words of a chunk."""
    low = lower_ascii(data)
    start, end, row = word_bounds(low, offsets)
    return word_hashes(low, start, end), end - start, row


def counts(texts: DataFrame) -> DataFrame:
    """(word, length, n) over all words; ``texts`` has the one column text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 0):
            data, offsets = text_buffers(batch.column(0))
            for a, b in chunks(offsets, 4 << 20):
                h, length, _ = words_in(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                word, first, n = np.unique(h, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(length[first].astype(np.int32)), pa.array(n)], names=["word", "length", "n"])

    return texts.mapInArrow(run, "word long, length int, n long").groupBy("word").agg(F.min("length").alias("length"), F.sum("n").alias("n"))


def vocabulary(every: DataFrame) -> Vocabulary:
    """The known words and what there is beside them; ``every`` is what ``counts`` gives."""
    top = every.orderBy(F.desc("n"), "word").limit(KNOWN).toPandas()
    by_length = every.groupBy(F.floor(F.least(F.col("length"), F.lit(LENGTHS * 2 - 1)) / 2).cast("int").alias("c")).agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(KNOWN)
    n[: len(top)] = top["n"]
    rare = np.bincount(by_length["c"], weights=by_length["n"], minlength=LENGTHS) - np.bincount(length_group(top["length"].to_numpy()), weights=top["n"], minlength=LENGTHS)
    inner = (n + 1e-3).reshape(GROUPS, GROUP)
    mass = np.concatenate([inner.sum(axis=1), rare + 1.0])
    hashes = top["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return Vocabulary(hashes[order], order, np.log(mass / mass.sum()), np.log(inner / inner.sum(axis=1, keepdims=True)), rare)


def _shift(y: np.ndarray) -> None:
    """Rows less a number of their own or of all, in place, so that neither they nor their sum of exponentials overflow or vanish."""
    most = y.max()
    y -= most if most - y.min() < SPAN else y.max(axis=1, keepdims=True)


def _softmax_less(y: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Softmax less one in the column ``at`` of each row, by ``n``; in place."""
    _shift(y)
    np.exp(y, out=y)
    y *= (1 / (n * (y @ np.ones(y.shape[1], y.dtype))))[:, None]
    y[np.arange(len(y)), at] -= y.dtype.type(1 / n)
    return y


def _log_softmax_at(y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of one column of each row; ``y`` is lost."""
    _shift(y)
    own = y[np.arange(len(y)), at]
    np.exp(y, out=y)
    return own - np.log(y @ np.ones(y.shape[1], y.dtype))


class Network:
    """Embeddings scaled by position, one rectified layer, softmax over groups and within one."""

    def __init__(self, embed: np.ndarray, scale: np.ndarray, out: np.ndarray, inner: np.ndarray):
        self.embed = embed  # kind, hidden
        self.scale = scale  # place beside the word, hidden
        self.out = out  # hidden and a bias, group
        self.inner = inner  # group, hidden and a bias, word within

    @classmethod
    def start(cls, vocab: Vocabulary) -> Network:
        rng = np.random.default_rng(5)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        out, inner = small(HIDDEN + 1, GROUPS + LENGTHS), small(GROUPS, HIDDEN + 1, GROUP)
        out[-1], inner[:, -1] = vocab.group_prior, vocab.inner_prior
        return cls(3 * small(KINDS, HIDDEN), 1 + 5 * small(2 * REACH, HIDDEN), out, inner)

    def copy(self) -> Network:
        return Network(*(x.copy() for x in (self.embed, self.scale, self.out, self.inner)))

    def hidden(self, around: np.ndarray) -> np.ndarray:
        """Hidden layer and a one for the bias, by position."""
        h = np.ones((around.shape[1], HIDDEN + 1), np.float32)
        z = self.embed.take(around[0], axis=0) * self.scale[0]
        for j in range(1, 2 * REACH):
            z += self.embed.take(around[j], axis=0) * self.scale[j]
        np.maximum(z, 0, out=h[:, :HIDDEN])
        return h

    def log_probabilities(self, around: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Of each word's group and, for known words, of the word within it."""
        h = self.hidden(around)
        group = np.where(kind < KNOWN, kind // GROUP, kind - KNOWN + GROUPS)
        out = _log_softmax_at(h @ self.out, group).astype(float)
        for g, at in _segments(kind):
            out[at] += _log_softmax_at(h.take(at, axis=0) @ self.inner[g], kind[at] % GROUP)
        return out


def _segments(kind: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Positions of the known words of each group."""
    order = np.argsort(kind.astype(np.uint16), kind="stable")
    cuts = np.searchsorted(kind[order], np.arange(GROUPS + 1) * GROUP)
    for g in np.flatnonzero(np.diff(cuts)):
        yield int(g), order[cuts[g] : cuts[g + 1]]


class Trainer:
    """Gradient descent on a network, steps scaled by the gradients so far; counts the words behind each part."""

    def __init__(self, net: Network):
        self.net = net
        self.squares = [np.full(x.shape, 1e-8, np.float32) for x in (net.embed, net.scale, net.out, net.inner)]
        self.as_input, self.as_output, self.seen = np.zeros(KINDS, np.int64), np.zeros(GROUPS, np.int64), 0

    def _move(self, part: int, weights: np.ndarray, at, gradient: np.ndarray) -> None:
        self.squares[part][at] += gradient * gradient
        weights[at] -= RATE * gradient / np.sqrt(self.squares[part][at])

    def step(self, around: np.ndarray, kind: np.ndarray) -> None:
        net, n = self.net, len(kind)
        h = net.hidden(around)
        group = np.where(kind < KNOWN, kind // GROUP, kind - KNOWN + GROUPS)
        y = _softmax_less(h @ net.out, group, n)
        back = y @ net.out.T
        inner = []
        for g, at in _segments(kind):
            here = h.take(at, axis=0)
            own = _softmax_less(here @ net.inner[g], kind[at] % GROUP, n)
            back[at] += own @ net.inner[g].T
            inner.append((g, here.T @ own))
            self.as_output[g] += len(at)
        z = back[:, :HIDDEN] * (h[:, :HIDDEN] > 0)
        scale = np.stack([np.einsum("ij,ij->j", z, net.embed.take(around[j], axis=0)) for j in range(2 * REACH)])
        # Sums of the gradients of each kind: sorted, then added up run by run.
        flat = around.astype(np.uint16).ravel()
        order = np.argsort(flat, kind="stable")
        times = np.bincount(flat, minlength=KINDS)
        rows = np.flatnonzero(times)
        times = times[rows]
        first = np.cumsum(times) - times
        each = (z[None] * net.scale[:, None]).reshape(-1, HIDDEN).take(order, axis=0)
        self._move(0, net.embed, rows, np.add.reduceat(each, first, axis=0))
        self._move(1, net.scale, slice(None), scale)
        self._move(2, net.out, slice(None), h.T @ y)
        for g, gradient in inner:
            self._move(3, net.inner, g, gradient)
        self.as_input[rows] += times
        self.seen += n

    def blocks(self) -> Iterator[tuple[int, bytes, int]]:
        """Parts of the network with the words that moved each: embeddings and inner layers by
        group of words, and all the rest."""
        net = self.net
        for g in range(GROUPS):
            if n := int(self.as_input[g * GROUP : (g + 1) * GROUP].sum()):
                yield g, net.embed[g * GROUP : (g + 1) * GROUP].tobytes(), n
            if self.as_output[g]:
                yield GROUPS + g, net.inner[g].tobytes(), int(self.as_output[g])
        if self.seen:
            yield 2 * GROUPS, b"".join(x.tobytes() for x in (net.embed[KNOWN:], net.scale, net.out)), self.seen


def assembled(net: Network, blocks: list[tuple[int, bytes]]) -> Network:
    """``net`` with the given blocks in place of its own."""
    net = net.copy()
    for i, raw in blocks:
        x = np.frombuffer(raw, np.float32)
        if i < GROUPS:
            net.embed[i * GROUP : (i + 1) * GROUP] = x.reshape(GROUP, HIDDEN)
        elif i < 2 * GROUPS:
            net.inner[i - GROUPS] = x.reshape(HIDDEN + 1, GROUP)
        else:
            a, b = (KINDS - KNOWN) * HIDDEN, 2 * REACH * HIDDEN
            net.embed[KNOWN:], net.scale, net.out = x[:a].reshape(-1, HIDDEN), x[a : a + b].reshape(-1, HIDDEN).copy(), x[a + b :].reshape(HIDDEN + 1, -1).copy()
    return net


def surroundings(kind: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Kinds of the neighbours of the words ``at``; the last kind where the document has none."""
    out = np.full((2 * REACH, len(at)), KINDS - 1, np.int64)
    for j, d in enumerate([*range(-REACH, 0), *range(1, REACH + 1)]):
        to = at + d
        ok = (to >= 0) & (to < len(kind))
        ok[ok] = row[to[ok]] == row[at[ok]]
        out[j, ok] = kind[to[ok]]
    return out


def _averaged(table: pa.Table) -> pa.Table:
    weights, seen = table.column("weights").to_pylist(), table.column("seen").to_numpy()
    total = np.zeros(len(weights[0]) // 4)
    for raw, n in zip(weights, seen, strict=True):
        total += np.frombuffer(raw, np.float32) * float(n)
    mean = (total / seen.sum()).astype(np.float32).tobytes()
    return pa.table({"block": table.column("block")[:1], "bin": table.column("bin")[:1], "weights": pa.array([mean], pa.binary()), "seen": pa.array([int(seen.sum())])})


def train(texts: DataFrame, vocab: Vocabulary) -> Network:
    """A network averaged over the tasks, after ``ROUNDS`` rounds."""
    net = Network.start(vocab)
    schema = "block int, bin int, weights binary, seen long"

    def one_round(net: Network, part: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(net.copy())
            for batch in pieces(batches, 0):
                data, offsets = text_buffers(batch.column(0))
                for a, b in chunks(offsets):
                    h, length, row = words_in(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    if not len(h):
                        continue
                    place = (np.arange(len(h)) - np.searchsorted(row, np.arange(row[-1] + 1))[row]).astype(np.uint64)
                    at = np.flatnonzero(mix(h + place * U(0x9E3779B97F4A7C15)) % U(ROUNDS) == part)
                    kind = vocab.look_up(h, length)
                    around = surroundings(kind, row, at)
                    for s in range(0, len(at), BATCH):
                        trainer.step(around[:, s : s + BATCH], kind[at[s : s + BATCH]])
            found = list(trainer.blocks())
            task = TaskContext.get().partitionId() % BINS
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in found], pa.int32()), pa.array([task] * len(found), pa.int32()), pa.array([x[1] for x in found], pa.binary()), pa.array([x[2] for x in found], pa.int64())],
                names=["block", "bin", "weights", "seen"],
            )

        return run

    for part in range(ROUNDS):
        sent = texts.mapInArrow(one_round(net, part), schema)
        sent = sent.groupBy("block", "bin").applyInArrow(_averaged, schema).groupBy("block").applyInArrow(_averaged, schema)
        net = assembled(net, [(r["block"], bytes(r["weights"])) for r in sent.collect()])  # a row for each block of the model
    return net


def score(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, log_likelihood (the sum), mean_log_likelihood."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = materialize(counts(source.select("text")))
    vocab = vocabulary(every)
    net = train(source.select("text"), vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_row = TaskContext.get().partitionId() << 36
        for batch in pieces(batches, 1):
            data, offsets = text_buffers(batch.column(1))
            total, words = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            rare_row, rare_word, rare_times = [], [], []
            for a, b in chunks(offsets, 1 << 18):
                h, length, row = words_in(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if not len(h):
                    continue
                kind, found = vocab.look_up(h, length), np.zeros(len(h))
                for s in range(0, len(h), 16_384):
                    at = np.arange(s, min(s + 16_384, len(h)))
                    found[at] = net.log_probabilities(surroundings(kind, row, at), kind[at])
                total[a:b] = np.bincount(row, weights=found, minlength=b - a)
                words[a:b] = np.bincount(row, minlength=b - a)
                rare = np.flatnonzero(kind >= KNOWN)
                order = rare[np.lexsort((h[rare], row[rare]))]
                new = np.ones(len(order), bool)
                new[1:] = (row[order][1:] != row[order][:-1]) | (h[order][1:] != h[order][:-1])
                heads = np.flatnonzero(new)
                rare_row.append(row[order][heads] + a)
                rare_word.append(h[order][heads])
                rare_times.append(np.diff(np.append(heads, len(order))))
            row = np.concatenate([np.zeros(0, np.int64), *rare_row])
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            pairs = pa.StructArray.from_arrays(
                [pa.array(np.concatenate([np.zeros(0, np.uint64), *rare_word]).view(np.int64)), pa.array(np.concatenate([np.zeros(0, np.int64), *rare_times]).astype(np.int32))], ["word", "times"]
            )
            ids = next_row + np.arange(batch.num_rows)
            next_row += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), batch.column(0), pa.array(words), pa.array(total), pa.ListArray.from_arrays(pa.array(ends), pairs)], names=["row", "doc_id", "n_words", "known", "rare"]
            )

    rows = materialize(source.mapInArrow(run, "row long, doc_id long, n_words long, known double, rare array<struct<word: long, times: int>>"))
    # A rare word's share of its length group, from the counts of the whole corpus.
    of_group = F.element_at(F.array(*[F.lit(float(np.log(max(x, 1.0)))) for x in vocab.rare]), (F.floor(F.least(F.col("length"), F.lit(LENGTHS * 2 - 1)) / 2) + 1).cast("int"))
    met = rows.select("row", F.inline("rare")).join(every, "word")
    rest = met.groupBy("row").agg(F.sum(F.col("times") * (F.log("n") - of_group)).alias("rest"))
    total = F.col("known") + F.coalesce("rest", F.lit(0.0))
    return rows.select("row", "doc_id", "n_words", "known").join(rest, "row", "left").select(
        "doc_id", "n_words", total.alias("log_likelihood"), F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("mean_log_likelihood")
    )
