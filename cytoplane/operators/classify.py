"""Softmax classifier on embeddings with a held-out batch."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoplane.functions.vectors import argmax


def _features(rows: DataFrame) -> DataFrame:
    return rows.withColumn("features", array_to_vector(F.col("vec").cast("array<double>")))


def fit_classifier(
    rows: DataFrame, held_out: int | None = None, penalty: float = 1e-4, rounds: int = 50
) -> LogisticRegressionModel:
    """Multinomial fit on ``vec, code, batch``, one batch left out."""
    train = rows if held_out is None else rows.where(F.col("batch") != F.lit(held_out))
    learner = LogisticRegression(
        featuresCol="features", labelCol="code", family="multinomial", regParam=penalty, maxIter=rounds
    )
    return learner.fit(_features(train))


def predict(model: LogisticRegressionModel, rows: DataFrame) -> DataFrame:
    """Class probabilities and their argmax for every row given."""
    scored = model.transform(_features(rows))
    probs = vector_to_array("probability")
    return scored.drop("features", "rawPrediction", "prediction").withColumn(
        "probability", probs
    ).withColumn("pred_code", argmax(F.col("probability")))
