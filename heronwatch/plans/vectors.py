"""Queries of the classifier with given weights: every figure has its SQL.

The weights are those of nearest class means, one dense layer each: a vector goes to the class
whose mean is nearest. The means come from the training rows as sums of whole numbers, so both
engines have the same weights; there is one row for each class and dimension of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import classify

CLASSES = 10
#: Every so-manieth position is a test row.
TEST_OF = 5
#: Net -> decimals of its weights.
NETS = {"fine": 4, "coarse": 0}


def _vectors(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def nearest_mean(train, decimals: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """One layer that scores each class by closeness to its mean, rounded."""
    each = train.select("label", F.posexplode("features").alias("i", "x"))
    sums = each.groupBy("label", "i").agg(F.sum(F.round(F.col("x") * 1e6).cast("long")).alias("s"), F.count("*").alias("n")).toPandas()
    mean = np.zeros((int(sums["i"].max()) + 1, CLASSES))
    mean[sums["i"], sums["label"]] = (sums["s"] / (sums["n"] * 1e6)).round(decimals)
    bias = np.where(np.isin(np.arange(CLASSES), sums["label"]), -(mean * mean).sum(axis=0) / 2, -np.inf)
    return [(mean, bias)]


def _predicted(spark, sf_dir, net: str = "fine"):
    train, test = classify.prepared(_vectors(spark, sf_dir), 1.0, TEST_OF)
    return classify.predicted(test, nearest_mean(train, NETS[net]))


def forward_pass(spark, sf_dir):
    """The class of every test row, by given weights (M1, M4)."""
    return _predicted(spark, sf_dir).select("vec_id", "label", "prediction")


def nets_compared(spark, sf_dir):
    """Accuracy of two nets on the test rows, and how many points apart they are (M5, M7)."""
    out = None
    for net in NETS:
        one = _predicted(spark, sf_dir, net).withColumn("net", F.lit(net))
        out = one if out is None else out.unionByName(one)
    return classify.compared(classify.accuracy(out, "net"))


def mean_confusion(spark, sf_dir):
    """Confusion matrix of the test rows (M6)."""
    return classify.confusion(_predicted(spark, sf_dir), CLASSES)


def mean_confused(spark, sf_dir):
    """The five pairs of labels mixed up most."""
    return classify.most_confused(_predicted(spark, sf_dir, "coarse"))


def first_wrong(spark, sf_dir):
    """The first ten test rows that are misclassified."""
    return classify.first_wrong(_predicted(spark, sf_dir, "coarse"))


def one_hot_labels(spark, sf_dir):
    """Labels as vectors of zeros and a one (M2)."""
    return _vectors(spark, sf_dir).select("vec_id", F.array_join(classify.one_hot(F.col("label"), CLASSES).cast("array<string>"), "").alias("one_hot"))


QUERIES = {f.__name__: f for f in (forward_pass, nets_compared, mean_confusion, mean_confused, first_wrong, one_hot_labels)}


def _net_sql(net: str) -> str:
    """Common table expressions: the weights and the predictions of a net."""
    return f"""WITH each AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id % {TEST_OF} <> 0),
      means AS (SELECT label, i, round_even(sum(round(x * 1e6)::BIGINT)::DOUBLE / (count(*) * 1e6), {NETS[net]}) AS m FROM each GROUP BY 1, 2),
      layer AS (SELECT label AS class, list(m ORDER BY i) AS w, -sum(m * m) / 2 AS b FROM means GROUP BY 1),
      pr AS (SELECT vec_id, label, arg_max(class, list_dot_product(embedding::DOUBLE[], w) + b)::INT AS prediction FROM embeddings, layer WHERE vec_id % {TEST_OF} = 0 GROUP BY ALL) """


SQL = {
    "forward_pass": _net_sql("fine") + "SELECT vec_id, label::INT AS label, prediction FROM pr",
    "nets_compared": "SELECT *, 100 * (accuracy - max(accuracy) OVER ()) AS points_behind FROM ("
    + " UNION ALL ".join(f"SELECT '{n}' AS net, n, \"right\", \"right\"::DOUBLE / n AS accuracy FROM ({_net_sql(n)} SELECT count(*) AS n, count(*) FILTER (label = prediction) AS \"right\" FROM pr)" for n in NETS) + ")",
    "mean_confusion": _net_sql("fine") + "SELECT label::INT AS label, " + ", ".join(f'count(*) FILTER (prediction = {c}) AS "{c}"' for c in range(CLASSES)) + " FROM pr GROUP BY 1",
    "mean_confused": _net_sql("coarse") + "SELECT label::INT AS label, prediction, count(*) AS n FROM pr WHERE label <> prediction GROUP BY 1, 2 ORDER BY n DESC, label, prediction LIMIT 5",
    "first_wrong": _net_sql("coarse") + "SELECT vec_id, label::INT AS label, prediction FROM pr WHERE label <> prediction ORDER BY vec_id LIMIT 10",
    "one_hot_labels": f"SELECT vec_id, array_to_string(list_transform(range({CLASSES}), lambda i: CASE WHEN i = label THEN '1' ELSE '0' END), '') AS one_hot FROM embeddings",
}
