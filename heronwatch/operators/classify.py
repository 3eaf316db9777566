"""A dense classifier over labelled vectors: training with MLlib, scoring as a matrix product."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prepared(vectors: DataFrame, scale: float, test_of: int) -> tuple[DataFrame, DataFrame]:
    """(training rows, test rows): features scaled; every ``test_of``-th position is for testing."""
    rows = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double") / scale).alias("features"), F.col("label").cast("int").alias("label"))
    at = F.pmod(F.col("vec_id"), F.lit(test_of))
    return rows.where(at != 0), rows.where(at == 0)


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == label).cast("int"))


def train(rows: DataFrame, layers: list[int], iterations: int = 60, seed: int = 7) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[float]]:
    """Weights by layer, as (matrix, bias), and the loss after each iteration."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    data = rows.select(array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"))
    model = MultilayerPerceptronClassifier(layers=layers, maxIter=iterations, seed=seed).fit(data)
    flat, at, out = np.array(model.weights.toArray()), 0, []
    for a, b in zip(layers[:-1], layers[1:], strict=True):
        matrix = flat[at : at + a * b].reshape(a, b)
        out.append((matrix, flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out, [float(x) for x in model.summary().objectiveHistory]


def forward(x: np.ndarray, weights: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    for i, (w, b) in enumerate(weights):
        x = x @ w + b
        if i < len(weights) - 1:
            x = 1.0 / (1.0 + np.exp(-x))
    return x


def predicted(rows: DataFrame, weights: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``rows`` with ``prediction``, the class with the largest output, batch by batch."""

    @F.pandas_udf("int")
    def best(features: pd.Series) -> pd.Series:
        return pd.Series(forward(np.stack(features.to_numpy()), weights).argmax(axis=1) if len(features) else [], dtype="int32")

    return rows.withColumn("prediction", best("features"))


def accuracy(rows: DataFrame, *by: str) -> DataFrame:
    hit = F.sum((F.col("label") == F.col("prediction")).cast("long"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), hit.alias("right"), (hit / F.count("*").cast("double")).alias("accuracy"))


def compared(accuracies: DataFrame) -> DataFrame:
    """``points_behind``: percentage points below the best of the nets (a row each)."""
    return accuracies.withColumn("points_behind", 100 * (F.col("accuracy") - F.max("accuracy").over(Window.partitionBy())))


def confusion(rows: DataFrame, classes: int) -> DataFrame:
    return rows.groupBy("label").pivot("prediction", list(range(classes))).count().na.fill(0)


def most_confused(rows: DataFrame, n: int = 5) -> DataFrame:
    return rows.where("label <> prediction").groupBy("label", "prediction").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label", "prediction").limit(n)


def first_wrong(rows: DataFrame, n: int = 10) -> DataFrame:
    return rows.where("label <> prediction").orderBy("vec_id").limit(n).select("vec_id", "label", "prediction")
