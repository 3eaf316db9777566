"""Months carried forward, kept tables, exact quantiles, bucket digests, names by a join, readings from files."""

import json
import statistics

import pytest
from pyspark.sql import functions as F

from heronwatch.functions import redaction
from heronwatch.operators import carried, diff, profile
from heronwatch.operators import person_month as pm
from heronwatch.plans import people, store
from heronwatch.sources import contracts, tables
from heronwatch.sources.testbed import LAST_MONTH, staging


def facts_of(spark, folder):
    return {n: staging(spark, folder, n) for n in ("directory", "exits", "bands", *people.FACTS)}


def rows_of(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_every_month_by_itself_equals_all_at_once(spark, small, tmp_path):
    n, facts, path = 8, {k: v.cache() for k, v in facts_of(spark, small).items()}, str(tmp_path / "t")
    first = LAST_MONTH - n + 1
    carried.start(path, facts, first, 1)
    for idx in range(first + 1, LAST_MONTH + 1):
        carried.carry(spark, path, facts, idx)
    carried.carry(spark, path, facts, LAST_MONTH - 2)  # a month that is run again gives the same rows
    whole = pm.person_360(*[facts[k] for k in ("directory", "exits", "bands", *people.FACTS)], LAST_MONTH, n)
    assert rows_of(carried.stored(spark, path), people.COLUMNS_360) == rows_of(whole, people.COLUMNS_360)
    with pytest.raises(ValueError, match="no state"):
        carried.carry(spark, path, facts, LAST_MONTH + 5)


def test_a_month_reads_its_own_facts_only(spark, small, tmp_path):
    facts, path = facts_of(spark, small), str(tmp_path / "t")
    carried.start(path, facts, LAST_MONTH - 1, 6)
    late = {k: v.where(F.col("idx") == LAST_MONTH) if "idx" in v.columns else v for k, v in facts.items()}
    carried.carry(spark, path, late, LAST_MONTH)
    whole = pm.person_360(*[facts[k] for k in ("directory", "exits", "bands", *people.FACTS)], LAST_MONTH, 7)
    assert rows_of(carried.stored(spark, path).where(F.col("idx") == LAST_MONTH), people.COLUMNS_360) == rows_of(whole.where(F.col("idx") == LAST_MONTH), people.COLUMNS_360)


def test_kept_table_is_made_once_and_pruned(spark, small, tmp_path, monkeypatch):
    made = []

    def build(spark, folder):
        made.append(folder)
        return spark.range(100).select((F.col("id") % 5).alias("idx"), F.col("id").alias("x"))

    one = store.kept(spark, small, "probe", build)
    two = store.kept(spark, small, "probe", build)
    assert len(made) == 1 and sorted(r.x for r in two.where("idx = 3").collect()) == list(range(3, 100, 5)) and one.schema == two.schema
    assert "PartitionFilters: [isnotnull(idx" in two.where("idx = 3")._jdf.queryExecution().toString()
    monkeypatch.setattr(tables, "stamp", lambda *_: "changed")
    store.kept(spark, small, "probe", build)
    assert len(made) == 2


def test_exact_quantiles(spark):
    values = {"a": [5.0, 1.0, 1.0, 9.0, None], "b": [2.5], "c": [None, None], "d": [float(x * x % 101) for x in range(1000)]}
    rows = spark.createDataFrame([(k, v, v) for k, vs in values.items() for v in vs], "g string, v double, w double").repartition(7)
    at = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r["column"], r.q): r.quantile for r in profile.quantiles(tables.staged(profile.value_counts(rows, ["v", "w"], ["g"])), at, ["g"]).collect()}
    for g, vs in values.items():
        have = sorted(v for v in vs if v is not None)
        for q in at:
            if have:
                k = (len(have) - 1) * q
                want = have[int(k)] + (have[min(int(k) + 1, len(have) - 1)] - have[int(k)]) * (k - int(k))
                assert got[g, "v", q] == got[g, "w", q] == pytest.approx(want)
    assert not any(g == "c" for g, _, _ in got)
    one = {r["column"]: r for r in profile.column_profile(rows, ["v"]).collect()}["v"]
    every = [v for vs in values.values() for v in vs if v is not None]
    assert (one.least, one.most, one.distinct, one.median) == (min(every), max(every), len(set(every)), statistics.median(every))
    plan = profile.column_profile(rows, ["v"])._jdf.queryExecution().toString()
    assert "percentile" not in plan and "median(" not in plan


def test_empty_profiles(spark):
    rows = spark.createDataFrame([], "v double, t string")
    assert profile.column_profile(rows, ["v"]).count() == 0 and profile.top_values(rows, ["t"]).count() == 0


def test_digests_find_what_differs(spark):
    a = spark.range(5000).select("id", (F.col("id") * 1.5).alias("d"), F.array("id").alias("l"))
    b = a.withColumns({"d": F.when(F.col("id") == 7, 0.0).otherwise(F.col("d")), "l": F.when(F.col("id") == 11, F.array()).otherwise(F.col("l"))})
    found = diff.unequal_buckets(a, b.repartition(9), ["id"], 1_000).collect()
    assert len(found) == 2
    few = {r["column"]: (r.differ, r.widest) for r in diff.local_cell_diff(a, b, ["id"], buckets=1_000).collect()}
    assert few == {r["column"]: (r.differ, r.widest) for r in diff.cell_diff(a, b, ["id"]).collect()} == {"d": (1, 10.5), "l": (1, None)}
    assert diff.unequal_buckets(a, a.orderBy(F.rand()), ["id"]).count() == 0
    assert {r["column"]: r.differ for r in diff.local_cell_diff(a, a.where("id <> 3"), ["id"]).collect()} == {"d": 1, "l": 1}


@pytest.mark.parametrize("most_sent", [0, 100_000])
def test_names_by_a_join(spark, most_sent):
    names = spark.createDataFrame([("Ana",), ("Ana Soto",), ("Soto",), ("Soto Luna",), ("de la O",), ("Zoë",), (None,), ("Ana",)], "name string")
    notes = {
        1: ("Ana Soto Luna", "[PERSON_1] Luna"), 2: ("Soto Luna, Ana", "[PERSON_1], [PERSON_2]"), 3: ("Anabel, mAna Ana_ Ana", "Anabel, mAna Ana_ [PERSON_1]"),
        4: ("Zoë's Zoë", "[PERSON_1]'s [PERSON_1]"), 5: (None, None), 6: ("", ""), 7: ("Ana  Soto", "[PERSON_1]  [PERSON_2]"), 8: ("x de la O.", "x [PERSON_1]."), 9: ("ana", "ana"), 10: ("Ana Soto Luna", "[PERSON_1] Luna"),
        11: ("Ana-Soto/Ana\nSoto Luna Ana", "[PERSON_1]-[PERSON_2]/[PERSON_1]\n[PERSON_3] [PERSON_1]"), 12: (" Ana " * 3000, " [PERSON_1] " * 3000),
    }
    rows = spark.createDataFrame([(i, t, "k") for i, (t, _) in notes.items()], "note_id int, text string, matches string")
    got = {r.note_id: r for r in redaction.masked_names(rows, names, most_sent=most_sent).collect()}
    assert {i: r.text for i, r in got.items()} == {i: m for i, (_, m) in notes.items()}
    assert got[11].matches == ["Ana", "Soto", "Soto Luna"] and got[5].matches == [] and got[6].matches == []
    assert "ArrowEvalPython" not in (plan := redaction.masked_names(rows, names)._jdf.queryExecution().toString()) and "MapInPandas" not in plan


def test_names_of_an_empty_directory(spark):
    rows = spark.createDataFrame([(1, "Ana")], "note_id int, text string")
    assert redaction.masked_names(rows, spark.createDataFrame([], "name string")).first().text == "Ana"


def test_dictionary_trims_signs(spark):
    people = spark.createDataFrame([(" Ana Soto Jr. ",), ("Dr. Luis de la Mar",), ("...",)], "name string")
    assert {r.name for r in redaction.name_dictionary(people).collect()} == {"Ana Soto Jr", "Ana", "Soto", "Dr. Luis de la Mar", "Luis", "Mar"}


def test_readings_from_indented_files(spark, tmp_path):
    good = {"hash": "a1", "tone": "neutral", "topics": ["pay"], "signals": [], "quotes": ["said \"so\""], "confidence": 0.5}
    (tmp_path / "one.json").write_text(json.dumps(good, indent=2))
    (tmp_path / "cut.json").write_text(json.dumps(good, indent=2)[:40])
    (tmp_path / "many.json").write_text(json.dumps([good | {"hash": "b2", "other": 1}, {"tone": "neutral"}], indent=1))
    (tmp_path / "kind.json").write_text(json.dumps(good | {"confidence": "much"}, indent=2))
    rows = contracts.read_json_files(spark, str(tmp_path), "hash string, tone string, topics array<string>, signals array<string>, quotes array<string>, confidence double", "hash").collect()
    found = {(r.file.rsplit("/", 1)[1], r.reject_reason, r.hash if r.reject_reason is None else None) for r in rows}
    assert len(rows) == 5 and found == {("one.json", None, "a1"), ("cut.json", "not readable", None), ("many.json", None, "b2"), ("many.json", "hash: missing", None), ("kind.json", "not readable", None)}
