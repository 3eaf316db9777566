"""Quality rules from lines that recur across the documents of a host.

Lines are normalised (lower case, digits to ``0``, white space to one space) and hashed. The
distinct documents that have a line are counted for each host (the ``source`` column); copies
of one whole text are one document. A line is above the limits if more than ``max_docs``
documents of the host have it and more than ``max_share`` of them. Lines above the limits are
removed (``query`` counts their words, ``keep`` cuts them out); a document that keeps too
little of itself is depleted and rejected, as is one that fails the base rules on length and
repetition.

Everything is built from DataFrame functions. A text is read once, into its measures and the
hashes of its lines, which are written and shared by the later steps; ``query`` shuffles no
text. A null or empty text has no words and fails the base rules, however long a text is, all
of its lines count; null sources form one host; rows that repeat in every way get the same
result; an empty table gives none; other columns of the input are ignored and may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize, shielded, unshielded

#: Fixed values of the word and symbol definitions.
SPACE = " \t\n\x0b\f\r"
SPACES = "[\\x20\\x09-\\x0D]+"
NOT_SPACE = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"

#: A line above both limits recurs: in so many documents of its host, in this share of them.
MAX_DOCS = 20
MAX_SHARE = 0.001
#: Rows of recurring lines that are sent to every task, at most: 16 bytes each.
MOST_SENT = 500_000
#: A document that keeps less than this share of its words, or fewer words, is depleted.
LEAST_SHARE_KEPT = 0.3
LEAST_WORDS_KEPT = 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text.

    Each window becomes one long: its hash above, its position in the low bits. After sorting,
    equal windows are neighbours. The hash keeps 64 bits less those of the position.
    """

    def covered(at: Column) -> Column:
        step = lambda i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(at, i + 1) - F.get(at, i), F.lit(3).cast("long")))
        return F.when(F.size(at) == 0, F.lit(0).cast("long")).otherwise(
            F.aggregate(F.sequence(F.lit(0), F.size(at) - 1), F.lit(0).cast("long"), lambda acc, i: acc + step(i))
        )

    def packed(bits: Column) -> Column:
        window = lambda i: F.call_function("shiftleft", F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), bits)
        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: window(i).bitwiseOR(i.cast("long"))))

    def twice(keys: Column, bits: Column) -> Column:
        top = lambda x: F.call_function("shiftright", x, bits)
        dup = F.filter(keys, lambda x, j: (top(x) == top(F.get(keys, j + 1))) | (top(x) == top(F.get(keys, j - 1))))
        low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        return F.sort_array(F.transform(dup, lambda x: x.bitwiseAND(low)))

    found = let(F.length(F.bin(F.size(words).cast("long"))), lambda bits: let(packed(bits), lambda keys: let(twice(keys, bits), covered)))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(found)


def measured(docs: DataFrame) -> DataFrame:
    """Row keys, doc_id, the base measures, and ``lines``: hash and words of each line with a word."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    of_words = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeat")))
    line = lambda x: F.struct(F.xxhash64(normal(x)).alias("line"), F.size(F.split(F.btrim(x, F.lit(SPACE)), SPACES)).cast("long").alias("words"))
    of_lines = let(
        F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE)),
        lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.transform(x, line).alias("all")),
    )
    bare = lambda chars: F.length(F.translate(text, chars, ""))
    out = docs.select(
        *row_key(docs), F.col("doc_id").cast("long").alias("doc_id"), of_words.alias("w"), bare(SPACE).cast("long").alias("word_chars"),
        (F.length(text) - bare(SYMBOLS)).cast("long").alias("n_symbols"), of_lines.alias("l"),
    )
    failed = (F.col("w.n") < 50) | (100 * F.col("w.repeat") > 50 * F.col("w.n"))
    return out.select(
        *KEYS, "doc_id", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.col("l.dup").alias("n_dup_lines"),
        F.col("w.repeat").alias("n_repeat_words"), failed.alias("base_failed"), F.col("l.all").alias("lines"),
    )


KEYS = ["_id", "_text", "_host"]


def row_key(docs: DataFrame) -> list[Column]:
    host = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_id"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_text"),
        F.xxhash64(F.coalesce(F.concat(F.lit("s"), host), F.lit("null"))).alias("_host"),
    ]


def normal(line: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), SPACES, " "))


def recurring(rows: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(_host, line) of the lines above the limits; ``rows`` has _host, _text and lines."""
    of_host = rows.select("_host", "_text").distinct().groupBy("_host").agg(F.count("*").alias("n_host"))
    has = rows.select("_host", "_text", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    often = has.distinct().groupBy("_host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > max_docs)
    return often.join(of_host, "_host").where(F.col("n_docs") > max_share * F.col("n_host")).select("_host", "line")


def judge(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """Per row of ``docs``: the base measures, n_line_words_removed, depleted, kept (and row keys);
    cut has the places of the removed lines among those with a word."""
    rows = materialize(measured(docs))
    above = materialize(recurring(rows, max_docs, max_share))
    lines = rows.select(*KEYS, F.posexplode("lines").alias("at", "one")).select(*KEYS, "at", "one.line", "one.words")
    # Few lines recur in a share of their host, and their number is known here; many are left to a shuffled join.
    above = F.broadcast(above) if above.count() <= MOST_SENT else above.hint("merge")
    hits = lines.join(above, ["_host", "line"])
    # Rows that repeat in every way have each place several times.
    gone = (
        hits.groupBy(*KEYS, "at").agg(F.max("words").alias("words"))
        .groupBy(*KEYS).agg(F.sum("words").alias("gone"), F.collect_list("at").alias("cut"))
    )
    out = rows.drop("lines").join(gone, KEYS, "left").withColumn("gone", F.coalesce("gone", F.lit(0).cast("long")))
    left = F.col("n_words") - F.col("gone")
    depleted = (F.col("gone") > 0) & ((left < LEAST_WORDS_KEPT) | (left < LEAST_SHARE_KEPT * F.col("n_words")))
    return out.withColumn("depleted", depleted).withColumnRenamed("gone", "n_line_words_removed").withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))


def query(docs: DataFrame) -> DataFrame:
    return judge(docs).drop(*KEYS, "cut")


def without_lines(text: Column, cut: Column) -> Column:
    """``text`` less the lines at the places ``cut`` among its lines with a word."""

    def rest(lines: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(lines) - 1)
        worded = F.filter(every, lambda i: F.get(lines, i).rlike(NOT_SPACE))
        gone = let(worded, lambda at: F.transform(cut, lambda k: F.get(at, k)))
        return F.array_join(F.transform(F.array_except(every, gone), lambda i: F.get(lines, i)), "\n")

    return let(F.split(text, "\n"), rest)


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, their texts without the removed lines.

    A text that loses nothing stays as it is. ``n_chars``, if there, is set anew with the text.
    """
    passed = judge(docs).where("kept").select(*KEYS, "cut").dropDuplicates(KEYS)
    rows = shielded(docs, *row_key(docs)).join(passed, KEYS)
    name = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    shorter, text = F.size("cut") > 0, name["text"]
    rows = rows.withColumn(text, F.when(shorter, without_lines(F.col(text).cast("string"), F.col("cut"))).otherwise(F.col(text)))
    if "n_chars" in name:
        n = name["n_chars"]
        rows = rows.withColumn(n, F.when(shorter, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n)))
    return unshielded(rows, docs)


#: DuckDB's form of ``query`` with the default limits.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce('s' || source, 'null') AS host FROM documents
), w AS (
  SELECT rid, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d
), win AS (
  SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid
), l0 AS (
  SELECT rid, host, t, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM (
    SELECT rid, host, t, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d)
), l AS (
  SELECT *, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm,
    len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words FROM l0
), hosts AS (
  SELECT host, count(DISTINCT t) AS texts FROM d GROUP BY host
), often AS (
  SELECT host, norm, count(DISTINCT t) AS texts FROM l GROUP BY host, norm
), freq AS (
  SELECT often.host, norm FROM often JOIN hosts ON often.host = hosts.host WHERE often.texts > 20 AND often.texts > 0.001 * hosts.texts
), gone AS (
  SELECT rid, sum(words) AS n FROM l JOIN freq USING (host, norm) GROUP BY rid
), dup AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n FROM l GROUP BY rid
), m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_line_words_removed
  FROM d JOIN w USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid)
), j AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    n_line_words_removed > 0 AND (n_words - n_line_words_removed < 20 OR n_words - n_line_words_removed < 0.3 * n_words) AS depleted FROM m
)
SELECT *, NOT base_failed AND NOT depleted AS kept FROM j
"""
