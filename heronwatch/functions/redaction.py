"""Personal data out of free text: patterns as columns, names by a join with a dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import staged

#: The patterns of what is masked, in this order.
ID = "\\bP\\d{5}\\b"
EMAIL = "[\\w.+-]+@[\\w.-]+\\.\\w+"
AMOUNT = "(?i)\\$\\s?\\d[\\d.,]*|\\b\\d[\\d.,]*\\s?(?:mil|millones|CLP|PEN|COP|MXN|BRL|USD)\\b"
#: Words inside names that are no names.
PARTICLES = ["da", "das", "de", "del", "do", "dos", "e", "la", "las", "los", "mac", "san", "van", "von", "y"]
TITLES = ["don", "dr", "ing", "lic", "md", "phd", "sr", "sra", "srta", "ii", "iii", "iv", "jr"]
NOT_NAMES = [*PARTICLES, *TITLES]
MOST_OF_ALL = 0.20
#: Names that are sent to every task; a larger dictionary is joined by a shuffle.
MOST_SENT = 100_000
#: A text is words and what is between them, in turn.
TOKENS = "(?U)\\w+|\\W+"


def masked_patterns(text: Column, clients: list[str] = ()) -> Column:
    """Ids, e-mails and amounts, then client names, longest first."""
    out = F.regexp_replace(text, ID, "[ID]")
    out = F.regexp_replace(out, EMAIL, "[EMAIL]")
    out = F.regexp_replace(out, AMOUNT, "[AMOUNT]")
    if clients:
        import re

        names = "|".join(re.escape(c) for c in sorted(clients, key=lambda c: (-len(c), c)))
        out = F.regexp_replace(out, f"\\b(?:{names})\\b", "[CLIENT]")
    return out


def content_hash(text: Column) -> Column:
    """The first 24 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 24)


def name_dictionary(directory: DataFrame, name: str = "name") -> DataFrame:
    """Full names and their capitalised parts of three letters or more, particles left out; names
    begin and end with a letter or digit."""
    full = F.regexp_replace(F.col(name), "(?U)^\\W+|\\W+$", "")
    parts = F.filter(F.split(full, "\\s+"), lambda t: (F.length(t) >= 3) & t.rlike("^\\p{Lu}") & ~F.lower(F.regexp_replace(t, "[.,]", "")).isin(NOT_NAMES))
    parts = F.transform(parts, lambda t: F.regexp_replace(t, "(?U)^\\W+|\\W+$", ""))
    return directory.select(F.explode(F.array_union(F.array(full), parts)).alias("name")).where("length(name) >= 3").distinct()


def name_matches(texts: DataFrame, names: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """_key, found: where names stand in ``texts`` (_key, _tokens), as (i, k, name) from token i on
    over k tokens, in order; of those that begin alike the longest comes first.

    Texts are exploded to runs of as many tokens as names have, which meet the names by equality.
    """
    known = names.select(F.col("name").alias("_name")).where("_name IS NOT NULL AND _name <> ''").distinct()
    sizes = sorted(r.k for r in known.select(F.size(F.regexp_extract_all("_name", F.lit(TOKENS), 0)).alias("k")).distinct().collect())  # lengths of names in words
    if not sizes:
        return texts.sparkSession.createDataFrame([], "_key binary, _found array<struct<i: int, less: int, k: int, name: string>>")
    words = texts.select("_key", "_tokens", F.posexplode("_tokens").alias("_i", "_word")).where(F.col("_word").rlike("(?U)^\\w"))
    run = lambda k: F.array_join(F.slice("_tokens", F.col("_i") + 1, k), "")
    runs = words.select("_key", "_i", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), run(k).alias("name")) for k in sizes])).alias("x"))
    runs = runs.select("_key", "_i", "x.k", F.col("x.name").alias("_name"))
    small = known.limit(most_sent + 1).count() <= most_sent
    met = runs.join(F.broadcast(known) if small else known.hint("merge"), "_name")
    at = F.struct((F.col("_i") + 1).alias("i"), (-F.col("k")).alias("less"), "k", F.col("_name").alias("name"))
    return met.groupBy("_key").agg(F.sort_array(F.collect_list(at)).alias("_found"))  # no more than the words of one text


def _folded(tokens: Column, found: Column) -> Column:
    """The text with its names masked, leftmost first, and the names in order of appearance."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        seen = F.when(F.array_contains(acc["seen"], x["name"]), acc["seen"]).otherwise(F.array_append(acc["seen"], x["name"]))
        before = F.array_join(F.slice(tokens, acc["at"], x["i"] - acc["at"]), "")
        mask = F.concat(F.lit("[PERSON_"), F.array_position(seen, x["name"]).cast("string"), F.lit("]"))
        taken = F.struct((x["i"] + x["k"]).alias("at"), seen.alias("seen"), F.concat(acc["out"], F.array(before, mask)).alias("out"))
        return F.when(x["i"] >= acc["at"], taken).otherwise(acc)

    rest = lambda acc: F.array_join(F.slice(tokens, acc["at"], F.greatest(F.size(tokens) - acc["at"] + 1, F.lit(0))), "")
    return F.aggregate(found, start, step, lambda acc: F.struct(F.concat(F.array_join(acc["out"], ""), rest(acc)).alias("text"), acc["seen"].alias("matches")))


def masked_names(notes: DataFrame, names: DataFrame, text: str = "text", most_sent: int = MOST_SENT) -> DataFrame:
    """``notes`` with names masked ``[PERSON_n]``, numbered by first appearance in the note, and
    ``matches``, the names found. The leftmost name wins, of those that begin alike the longest;
    a name begins and ends at a word's edge. ``names`` is a table with a column name, of any size.
    Equal texts are worked on once; a null text stays null and has no names.
    """
    keyed = notes.drop("matches").withColumn("_key", F.unhex(F.sha2(F.col(text), 256)))
    texts = keyed.where(F.col(text).isNotNull()).select("_key", F.col(text).alias("_text")).dropDuplicates(["_key"])
    texts = staged(texts.select("_key", F.regexp_extract_all("_text", F.lit(TOKENS), 0).alias("_tokens")))
    done = texts.join(name_matches(texts, names, most_sent), "_key").select("_key", _folded(F.col("_tokens"), F.col("_found")).alias("_done"))
    out = keyed.join(done, "_key", "left")
    matches = F.coalesce("_done.matches", F.array().cast("array<string>"))
    return out.select(*[F.coalesce("_done.text", F.col(text)).alias(c) if c == text else F.col(f"`{c}`") for c in notes.drop("matches").columns], matches.alias("matches"))


def stop_if_one_name_rules(masked: DataFrame, most: float = MOST_OF_ALL) -> None:
    """Raises if one name is more than a share of all masks: it is then a word, not a name."""
    n = masked.select(F.explode("matches").alias("name")).groupBy("name").count()
    top = n.orderBy(F.desc("count"), "name").limit(1).collect()
    total = n.agg(F.sum("count")).first()[0] or 0
    if top and total > 20 and top[0]["count"] / total > most:
        raise ValueError(f"{top[0]['name']!r} is {top[0]['count']} of {total} masks")
