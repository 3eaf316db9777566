"""Document fingerprints that can be subtracted: invertible Bloom lookup sketches.

A text's paragraphs (its lines with more than white space) are hashed. Each digest falls into
one cell of each of three sub-tables; a cell keeps a count, the XOR of its digests and the XOR
of their checks. The difference of two sketches holds only what the texts do not share, and is
peeled: a cell with one digest gives it up, which frees its other two cells. If cells stay
filled, the pair is sketched again with larger tables and other cells, until none is left. The
likeness of two texts is the Jaccard similarity of their paragraphs, from the digests recovered.

Everything is made of DataFrame functions. Each text is shuffled once and half of it a second
time; sketches stay in the partition of their document, so peeling shuffles nothing. A null
text is empty, a very long one is hashed whole; a null doc_id comes last in the order of
documents; rows that repeat in every way are one document, returned as often; no paragraphs on
either side count as alike. An empty table gives none; other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import ranked
from .storage import materialize

LAST = (1 << 63) - 1
TABLES = 3
#: Cells of a sub-table in the fingerprint itself and on the first try.
BASE_CELLS = 8
#: Cells of a sub-table for each paragraph of the two texts together: on the second try, and growth from try to try.
SECOND, GROWTH = 0.6, 4.0
#: From this many on, only the choice of cells changes: the table is then far larger than the pair.
MOST_CELLS_EACH = 40.0
#: Characters of text for each partition of sketches.
PARTITION_CHARS = 4 << 20
#: Passes over the sub-tables, one after the other, within one try.
PASSES = 4


def digests(text: Column) -> Column:
    """Distinct hashes of the paragraphs of a text."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))


def check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(99))


def cell(digest: Column, table: int, cells: Column, salt: int) -> Column:
    return (F.lit(table) * cells + F.pmod(F.xxhash64(digest, F.lit(17 * salt + table)), cells)).cast("long")


def _summed(cells: DataFrame, keys: list[str]) -> DataFrame:
    out = cells.groupBy(*keys).agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("chk").alias("chk"))
    return out.where("n <> 0 OR key <> 0 OR chk <> 0")


def sketched(elements: DataFrame, keys: list[str], salt: int) -> DataFrame:
    """Cells of the sketches of (keys, cells, sign, digest): keys, cells, cell, n, key, chk."""
    each = [F.struct(cell(F.col("digest"), t, F.col("cells"), salt).alias("cell")) for t in range(TABLES)]
    rows = elements.select(*keys, "cells", "sign", "digest", F.explode(F.array(*each)).alias("at"))
    rows = rows.select(*keys, "cells", "at.cell", F.col("sign").alias("n"), F.col("digest").alias("key"), check(F.col("digest")).alias("chk"))
    return _summed(rows, [*keys, "cells", "cell"])


def peeled(cells: DataFrame, keys: list[str], salt: int) -> DataFrame:
    """Cells after peeling. Recovered digests are rows with cell -1, the digest in ``got``, and
    n 1 or -1 for the side that has it; other rows left over mean failure."""
    zero = F.lit(0).cast("long")
    state = cells.withColumn("got", zero)
    for turn in range(TABLES * PASSES):
        one = (F.col("cell") >= 0) & (F.floor(F.col("cell") / F.col("cells")) == turn % TABLES) & (F.abs("n") == 1) & (F.col("chk") == check(F.col("key")))
        own = F.struct("cell", "n", "key", "chk", "got")
        out = [F.struct(cell(F.col("key"), t, F.col("cells"), salt).alias("cell"), (-F.col("n")).alias("n"), "key", "chk", "got") for t in range(TABLES)]
        got = F.struct(F.lit(-1).cast("long").alias("cell"), "n", zero.alias("key"), zero.alias("chk"), F.col("key").alias("got"))
        rows = state.select(*keys, "cells", F.explode(F.when(one, F.array(own, got, *out)).otherwise(F.array(own))).alias("x"))
        state = _summed(rows.select(*keys, "cells", "x.*"), [*keys, "cells", "cell", "got"])
    return state


def _pairs(rows: DataFrame) -> DataFrame:
    """Elements of both comparisons: (rid, pair, cells, sign, digest); pair 0 edited, 1 next."""
    side = lambda name, sign: F.transform(name, lambda d: F.struct(F.lit(sign).cast("long").alias("sign"), d.alias("digest")))
    both = [F.struct(F.lit(p).alias("pair"), F.col(f"cells{p}").alias("cells"), F.concat(side("own", 1), side(other, -1)).alias("e")) for p, other in enumerate(("edited", "next"))]
    out = rows.select("rid", F.explode(F.array(*both)).alias("x")).where("x.cells > 0")
    return out.select("rid", "x.pair", "x.cells", F.explode("x.e").alias("e")).select("rid", "pair", "cells", "e.sign", "e.digest")


def _tried(rows: DataFrame, salt: int) -> DataFrame:
    """rid, d0, d1: numbers of digests that differ; null where peeling failed."""
    left = peeled(sketched(_pairs(rows), ["rid", "pair"], salt), ["rid", "pair"], salt)
    sums = left.groupBy("rid").agg(*[
        x for p in (0, 1) for x in (
            F.sum(F.when((F.col("pair") == p) & (F.col("cell") < 0), 1).otherwise(0)).alias(f"d{p}"),
            F.sum(F.when((F.col("pair") == p) & (F.col("cell") >= 0), 1).otherwise(0)).alias(f"left{p}"),
        )
    ])
    return sums.select("rid", *[F.when(F.col(f"left{p}") == 0, F.col(f"d{p}")).alias(f"d{p}") for p in (0, 1)], *[(F.col(f"left{p}") > 0).alias(f"failed{p}") for p in (0, 1)])


def with_next(docs: DataFrame) -> DataFrame:
    """Each distinct document with its edited text's and its next document's digests.

    Columns: rid, doc_id, copies, n_chars, edited_sha256, own, edited, next (digests)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.col("doc_id").isNull()
    hash_ = F.when(none, F.xxhash64(F.lit(1), text)).otherwise(F.xxhash64(text))  # a null doc_id is not the largest one
    base = docs.select(none.alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), hash_.alias("hash"), text.alias("text"))
    ids = base.select("none", "id", "hash", F.length("text").alias("n")).groupBy("none", "id", "hash").agg(F.max("n").alias("n"), F.count("*").alias("copies"))
    ids = materialize(ranked(ids, ["none", "id", "hash"]))
    n, most = ids.agg(F.count("*"), F.max("copies")).first()
    after = ids.select(F.pmod(F.col("rank") - 1, F.lit(max(n, 1))).alias("rank"), F.col("id").alias("next_id"), F.col("hash").alias("next_hash"))
    links = ids.join(after, "rank").select(F.col("rank").alias("rid"), "next_id", "next_hash", F.col("id").alias("cur_id"), F.col("hash").alias("cur_hash"), F.floor(F.col("n") / 2).cast("int").alias("half"), "copies", "none")
    own = base.drop("none").withColumn("own", digests(F.col("text")))  # both uses below share one exchange of these columns
    if (most or 0) > 1:
        own = own.dropDuplicates(["id", "hash"])
    heads = own.join(links, (own["id"] == links["next_id"]) & (own["hash"] == links["next_hash"])).select("rid", "cur_id", "cur_hash", "half", "copies", "none", F.expr("substring(text, 1, half)").alias("head"), F.col("own").alias("next"))
    joined = own.join(heads, (own["id"] == heads["cur_id"]) & (own["hash"] == heads["cur_hash"]))
    edited = F.concat(F.expr("substring(text, 1, length(text) - half)"), F.col("head"))
    return joined.select(
        "rid", F.when(~F.col("none"), F.col("id")).alias("doc_id"), "copies", F.length("text").cast("long").alias("n_chars"),
        F.sha2(edited, 256).alias("edited_sha256"), "own", digests(edited).alias("edited"), "next",
    )


def likeness(both: Column, differing: Column) -> Column:
    """Jaccard similarity from the sizes of two sets added up and the size of their difference."""
    return F.when(both == 0, 1.0).otherwise((both - differing) / (both + differing))


def query(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = materialize(with_next(docs))
    sizes = {0: F.size("own") + F.size("edited"), 1: F.size("own") + F.size("next")}
    chars = rows.agg(F.sum("n_chars")).first()[0] or 0
    # A number of its own: sketches are many times the rows they are made of, which Spark's sizes do not show.
    by_rid = lambda df: df.repartition(max(1, int(2 * chars // PARTITION_CHARS)), "rid")
    placed = by_rid(rows)  # what joins these rows is dealt out alike, so that they stay where they are
    base = placed.select("rid", "own", "edited", "next", *[F.lit(BASE_CELLS).cast("long").alias(f"cells{p}") for p in (0, 1)])
    tried = materialize(_tried(base, 0))
    found = placed.select("rid", "own", "edited", "next").join(by_rid(tried), "rid", "left")
    # A pair without a row has no cells left: nothing differs.
    found = found.select("rid", *[sizes[p].alias(f"size{p}") for p in (0, 1)], *[F.when(F.coalesce(f"failed{p}", F.lit(False)), F.lit(None)).otherwise(F.coalesce(f"d{p}", F.lit(0))).cast("long").alias(f"d{p}") for p in (0, 1)])
    found, rate, salt = materialize(found), SECOND, 1
    while found.where("d0 IS NULL OR d1 IS NULL").take(1):
        again = [F.when(F.col(f"d{p}").isNull(), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(16.0), F.col(f"size{p}") * F.lit(rate)))))).otherwise(0).cast("long").alias(f"cells{p}") for p in (0, 1)]
        failed = placed.select("rid", "own", "edited", "next").join(by_rid(found.where("d0 IS NULL OR d1 IS NULL").select("rid", *again)), "rid")
        retried = _tried(failed, salt).select("rid", *[F.col(f"d{p}").alias(f"r{p}") for p in (0, 1)], *[F.col(f"failed{p}").alias(f"f{p}") for p in (0, 1)])
        found = materialize(
            found.join(materialize(retried), "rid", "left").select(
                "rid", "size0", "size1", *[F.coalesce(f"d{p}", F.when(~F.coalesce(f"f{p}", F.lit(False)), F.coalesce(f"r{p}", F.lit(0)))).cast("long").alias(f"d{p}") for p in (0, 1)],
            )
        )
        rate, salt = min(rate * GROWTH, MOST_CELLS_EACH), salt + 1
    near = found.select("rid", *[likeness(F.col(f"size{p}"), F.col(f"d{p}")).alias(f"near{p}") for p in (0, 1)])
    versions = F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("own").alias("e")), F.struct(F.lit(1).alias("v"), F.col("edited").alias("e")))).alias("x")
    elements = placed.select("rid", versions).select("rid", "x.v", F.explode("x.e").alias("digest")).select("rid", "v", F.lit(BASE_CELLS).cast("long").alias("cells"), F.lit(1).cast("long").alias("sign"), "digest")
    parts = sketched(elements, ["rid", "v"], 0).select("rid", "v", F.struct("cell", "n", "key", "chk").alias("c"))
    shown = lambda v: F.concat_ws(".", F.transform(F.sort_array(F.collect_list(F.when(F.col("v") == v, F.col("c")))), lambda c: F.concat_ws(":", F.lower(F.hex(c["cell"])), F.lower(F.hex(c["n"])), F.lower(F.hex(c["key"])), F.lower(F.hex(c["chk"])))))
    prints = parts.groupBy("rid").agg(shown(0).alias("fingerprint"), shown(1).alias("edited_fingerprint"))
    out = placed.select("rid", "doc_id", "copies", "n_chars", "edited_sha256").join(prints, "rid", "left").join(by_rid(near), "rid", "left")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", F.coalesce("fingerprint", F.lit("")).alias("fingerprint"), F.coalesce("edited_fingerprint", F.lit("")).alias("edited_fingerprint"),
        F.col("near0").alias("near_edited"), F.col("near1").alias("near_next"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"),
    ).drop("_copy")
