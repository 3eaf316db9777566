"""Mixing sources to target weights by cube-method balanced sampling.

Each source gets a target: its share by weight of all words, at most ``MOST_REPEATS`` times
what it has, the excess shared again by weight. A document is taken ``floor(target / size)``
times for sure, and once more with the fractional rest as its inclusion probability. The cube
method rounds these probabilities: three documents at a time move along the null space of the
two balancing equations (words and documents) until one of them is in or out, so both totals
of the source stay as they are. This runs in small blocks of a source; what blocks leave open
meets in fewer blocks, until the last few documents of a source are rounded together, choosing
of all their subsets the one nearest the source's words.

Moves are drawn from a generator seeded by source and block, so reruns agree. Null texts have
no words, very long ones count whole; null sources are one source, the last; empty sources get
nothing; rows that repeat are separate candidates. Rows keep their place whatever their doc_id;
an empty table gives none, and other columns may have any name.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import ranked
from .storage import materialize, shielded, unshielded

MOST_REPEATS = 3
WEIGHTS = (1, 2, 3)
#: Documents of one block, about.
BLOCK = 500
#: Open documents that a block hands on, and that a source rounds together at the end, at most.
LANDING = 12


def flight(pi: np.ndarray, size: np.ndarray, stop: int, seed: int) -> np.ndarray:
    """Inclusion probabilities moved to 0 or 1, but for ``stop`` of them at most (2 at least),
    with sum(pi) and sum(pi * size) kept."""
    p, s = pi.tolist(), size.tolist()
    live = [i for i, x in enumerate(p) if 0.0 < x < 1.0]
    draws = np.random.default_rng(seed).random(len(live) + 3).tolist()
    held, at, step = [], 0, 0
    while True:
        while len(held) < 3 and at < len(live):
            held.append(live[at])
            at += 1
        if len(held) < 3 or len(held) + len(live) - at <= stop:
            break
        i, j, k = held
        u = (s[j] - s[k], s[k] - s[i], s[i] - s[j])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        top = bottom = 0
        for n, x in enumerate(u):
            if x:
                v = p[held[n]]
                rise, fall = ((1.0 - v) / x, v / x) if x > 0 else (v / -x, (1.0 - v) / -x)
                if rise < up:
                    up, top = rise, n
                if fall < down:
                    down, bottom = fall, n
        rising = draws[step % len(draws)] * (up + down) < down
        step += 1
        move, hit = (up, top) if rising else (-down, bottom)
        for n, x in enumerate(u):
            p[held[n]] = min(1.0, max(0.0, p[held[n]] + move * x))
        p[held[hit]] = float((u[hit] > 0) == rising)
        held = [x for x in held if 1e-9 < p[x] < 1.0 - 1e-9]
        # What rounding has brought to the edge is there.
    return np.array([float(round(x)) if x <= 1e-9 or x >= 1.0 - 1e-9 else x for x in p])


def landing(pi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The open probabilities rounded so that the words, then the documents, come nearest."""
    out = pi.copy()
    rest = np.flatnonzero((pi > 0) & (pi < 1))
    if len(rest):
        sets = (np.arange(1 << len(rest))[:, None] >> np.arange(len(rest))) & 1
        off = np.abs(sets @ size[rest] - pi[rest] @ size[rest])
        off_n = np.abs(sets.sum(axis=1) - pi[rest].sum())
        out[rest] = sets[np.lexsort((np.arange(len(sets)), off_n, off))[0]]
    return out


def _block(last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_order", "doc_id", "size"], kind="stable")
        seed = zlib.crc32(f"{rows['_source'].iloc[0]}/{rows['_block'].iloc[0]}/{last}".encode())
        size = rows["size"].to_numpy(float)
        pi = flight(rows["_pi"].to_numpy(float), size, LANDING, seed)
        return rows.assign(_pi=landing(pi, size) if last else pi)

    return run


def targets(rows: DataFrame) -> DataFrame:
    """_source, source_size, _n, target of every source of ``rows`` (_source, size)."""
    sources = rows.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    sources = materialize(ranked(sources, ["_source"]).withColumn("weight", weight).drop("rank"))
    sources = sources.withColumn("ratio", MOST_REPEATS * F.col("source_size") / F.col("weight"))
    total, weights = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    # In the order of what a unit of weight can hold, a source is full if the level that all
    # later ones would share reaches it.
    filled = ranked(sources, ["ratio", "_source"], {"before_size": "source_size", "before_weight": "weight"})
    level = F.try_divide(F.lit(float(total)) - MOST_REPEATS * F.col("before_size"), F.lit(float(weights)) - F.col("before_weight"))
    filled = materialize(filled.withColumn("full", level >= F.col("ratio")))
    full = filled.where("full").agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    share = (total - MOST_REPEATS * full[0]) / (weights - full[1]) if weights > full[1] else 0.0
    target = F.when(F.col("full"), MOST_REPEATS * F.col("source_size").cast("double")).otherwise(F.lit(float(share)) * F.col("weight"))
    return materialize(filled.select("_source", "source_size", "_n", target.alias("target")))


def _blocks(rows: DataFrame, count: Column) -> DataFrame:
    """Rows with their block: a hash deals the documents of a source over blocks of like size."""
    n = F.greatest(F.lit(1).cast("long"), F.ceil(count / BLOCK))
    return rows.withColumn("_block", F.pmod(F.xxhash64("_order", F.lit(7)), n))


def copies(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, copies and ``_order`` (its key)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("t")).alias("_source"),
        F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("size"),
        F.xxhash64("doc_id", "text", "source").alias("_order"),
    )
    rows = materialize(rows)
    rate = F.least(F.lit(float(MOST_REPEATS)), F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)))
    state = rows.join(targets(rows), "_source").withColumn("_rate", rate)
    state = state.withColumn("_whole", F.floor("_rate")).withColumn("_pi", F.col("_rate") - F.col("_whole")).drop("_rate")
    state = _blocks(state, F.col("_n"))
    done = []
    while True:
        state = materialize(state.groupBy("_source", "_block").applyInPandas(_block(False), state.schema))
        done.append(state.where("_pi = 0 OR _pi = 1"))
        rest = state.where("_pi > 0 AND _pi < 1").drop("_n", "_block")
        left = materialize(rest.groupBy("_source").agg(F.count("*").alias("_n")))
        most = left.agg(F.max("_n")).first()[0] or 0
        rest = rest.join(left, "_source")
        if most <= BLOCK:
            last = rest.withColumn("_block", F.lit(-1).cast("long")).select(*state.columns)
            done.append(last.groupBy("_source", "_block").applyInPandas(_block(True), state.schema))
            break
        state = _blocks(rest, F.col("_n")).select(*state.columns)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "_order", "size", "source_size", "target", (F.col("_whole") + F.round("_pi").cast("long")).alias("copies"))


def query(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words, repeats counted)."""
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def keep(docs: DataFrame) -> DataFrame:
    """``docs`` mixed: each row as often as it is taken, with its columns unchanged."""
    key = ["_order", "_doc"]
    taken = copies(docs).select("_order", F.coalesce("doc_id", F.lit(0)).alias("_doc"), "copies").groupBy(*key).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows"))
    own = shielded(docs, F.xxhash64("doc_id", "text", "source").alias("_order"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_doc"))
    joined = own.join(taken.where("_copies > 0").hint("merge"), key)
    # Rows that repeat in every way share their copies, which differ by one at most.
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*key))
    each = (F.floor(F.col("_copies") / F.col("_rows")) + (F.col("_place") <= F.col("_copies") % F.col("_rows")).cast("long")).cast("int")
    joined = joined.withColumn("_place", place).withColumn("_each", each).where("_each > 0")
    return unshielded(joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_each")))), docs)
