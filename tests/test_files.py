import numpy as np
import pytest
from pyspark.sql import functions as F

from heronwatch.operators import classify, ranking, rules, validate
from heronwatch.sources import tables
from heronwatch.sources.contracts import Contract, ContractError, Field, conform, read_csv, read_json

PETS = Contract("pets", ("name",), {"name": Field("text", True, least_length=3), "kind": Field("text", True, domain=("cat", "dog")), "weight": Field("number", low=0, high=90)}, {"Nombre": "name", "Peso": "weight"})


def test_sheet_with_domain_and_least_length(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Nombre ,kind, Peso,secret\n" Rex ",dog,"12,5",x\nMo,cat,4,x\nTweety,bird,1,x\nKater,cat,N/A,x\nBello,dog,400,x\n')
    raw = read_csv(spark, str(tmp_path), ["Nombre ", "kind", " Peso", "secret"])
    assert {f.dataType.simpleString() for f in raw.schema} == {"string"}
    rows = validate.judged(conform(raw, PETS), PETS)
    assert rows.columns[:3] == ["name", "kind", "weight"]
    got = {r["name"]: (r.kind, r.weight, r.reject_reason) for r in rows.collect()}
    assert got == {"Rex": ("dog", 12.5, None), "Mo": ("cat", 4.0, "name: short"), "Tweety": ("bird", 1.0, "kind: domain"), "Kater": ("cat", None, None), "Bello": ("dog", None, None)}
    schema = PETS.schema()
    assert not schema["name"].nullable and schema["weight"].nullable and "one of cat, dog" in schema["kind"].metadata["comment"]
    clean, rejected = validate.split_and_write(rows, str(tmp_path / "out"))
    assert clean.count() == 3 and "reject_reason" not in clean.columns and {r[0] for r in rejected.select("reject_reason").collect()} == {"name: short", "kind: domain"}
    with pytest.raises(ContractError, match="weight"):
        conform(raw.drop(" Peso"), PETS)


def test_partitions_are_replaced_and_appended(spark, tmp_path):
    path = str(tmp_path / "t")
    table = lambda *rows: spark.createDataFrame(rows, "v int, month int")
    tables.replace(table((1, 1), (2, 2)), path, "month")
    tables.replace(table((20, 2)), path, "month")
    tables.append(table((3, 3), (21, 2)), path, "month")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, 1), (3, 3), (20, 2), (21, 2)]
    tables.replace(table((9, 9)), path)
    assert spark.read.parquet(path).count() == 1


def test_json_readings(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"hash": "a", "topics": ["load"], "more": 1}\n{"hash": "b", "confidence": 0.5}\n')
    got = {r.hash: (r.topics, r.confidence) for r in read_json(spark, str(tmp_path), "hash string, topics array<string>, confidence double").collect()}
    assert got == {"a": (["load"], None), "b": (None, 0.5)}


def test_positions_over_many_tasks(spark):
    rng = np.random.default_rng(5)
    rows = [(int(g), int(p), None if x < 0.1 else float(x), i) for i, (g, p, x) in enumerate(zip(rng.integers(0, 3, 500), rng.integers(0, 4, 500), rng.random(500), strict=True))] + [(None, 1, 0.5, 1000), (None, 1, 0.6, 1001)]
    df = spark.createDataFrame(rows, "g int, p int, x double, i int").repartition(7)
    got = {r.i: r.position for r in ranking.placed(df, ["g"], [F.col("p"), F.asc_nulls_last("x"), F.col("i")]).collect()}
    want, seen = {}, {}
    for g, _, _, i in sorted(rows, key=lambda r: (r[1], r[2] is None, r[2] or 0, r[3])):
        want[i] = seen[g] = seen.get(g, 0) + 1
    assert got == want


def test_guard_and_sink_order(spark):
    with pytest.raises(rules.CatalogError, match="1 dimension"):
        rules.guard_dimensions(spark.createDataFrame([(2,), (1,)], "dimensions int"))
    rules.guard_dimensions(spark.createDataFrame([], "dimensions int"))


def test_sink_is_sorted(spark, small):
    from heronwatch.plans.files import alerts_sink

    rows = [(r.period, r.channel, r.position) for r in alerts_sink(spark, small).coalesce(1).collect()]
    months = [p for p, _, _ in rows]
    assert months == sorted(months, reverse=True) and all(a[0] != b[0] or a[1:] < b[1:] for a, b in zip(rows, rows[1:], strict=False))


def test_forward_pass_and_figures(spark):
    rng = np.random.default_rng(1)
    w = [(rng.normal(size=(6, 5)), rng.normal(size=5)), (rng.normal(size=(5, 3)), rng.normal(size=3))]
    x, label = rng.normal(size=(80, 6)), rng.integers(0, 3, 80)
    rows = spark.createDataFrame([(i, [float(v) for v in a], int(b)) for i, (a, b) in enumerate(zip(x, label, strict=True))], "vec_id int, features array<double>, label int")
    want = (1 / (1 + np.exp(-(x @ w[0][0] + w[0][1]))) @ w[1][0] + w[1][1]).argmax(axis=1)
    out = classify.predicted(rows, w).cache()
    assert [r.prediction for r in out.orderBy("vec_id").collect()] == want.tolist()
    assert classify.accuracy(out).first().right == int((want == label).sum())
    matrix = {r["label"]: [r[str(k)] for k in range(3)] for r in classify.confusion(out, 3).collect()}
    assert matrix == {k: [int(((label == k) & (want == j)).sum()) for j in range(3)] for k in range(3)}
    assert [r.vec_id for r in classify.first_wrong(out, 4).collect()] == np.flatnonzero(want != label)[:4].tolist()
    assert [r[0] for r in out.orderBy("vec_id").limit(2).select(classify.one_hot(F.col("label"), 3)).collect()] == [[int(k == b) for k in range(3)] for b in label[:2]]
