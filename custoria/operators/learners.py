"""The learners of both models, all trained on distributed rows: by Spark ML, boosted trees by `boosting`."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F

from custoria.operators import boosting
from custoria.operators.boosting import BoostedTrees

SEED = 42
# Candidate splits per feature of a forest: more than Spark's default of 32, as the models compared here split exactly.
# Features with more distinct values are split at this many quantiles. Boosted trees have 256.
BINS = 128


def logistic_regression(train: DataFrame, label: str, weight: str, total_weight: float, max_iter: int = 1000):
    """L2-penalised logistic regression with unit penalty on scaled features.

    Spark divides the summed loss by the total weight, so the penalty is divided alike.
    """
    return LogisticRegression(
        featuresCol="scaled",
        labelCol=label,
        weightCol=weight,
        maxIter=max_iter,
        regParam=1.0 / total_weight,
        elasticNetParam=0.0,
        standardization=False,
        tol=1e-6,
    ).fit(train)


def random_forest(
    train: DataFrame, label: str, weight: str, trees: int = 300, depth: int = 6, seed: int = SEED, bins: int = BINS
):
    return RandomForestClassifier(
        featuresCol="features",
        labelCol=label,
        weightCol=weight,
        numTrees=trees,
        maxDepth=depth,
        maxMemoryInMB=512,
        maxBins=bins,
        seed=seed,
    ).fit(train)


def boosted_classifier(
    train: DataFrame,
    label: str,
    weight: str,
    rounds: int = 300,
    depth: int = 4,
    rate: float = 0.05,
    bins: int = boosting.MOST_BINS,
    folder: str | None = None,
) -> BoostedTrees:
    """Second-order boosted trees on the logistic loss, with unit penalty on leaves and at least unit Hessian in each.

    Nothing is drawn at random. A run that was cut off goes on from what it saved in `folder`.
    """
    settings = boosting.Settings(boosting.LOGISTIC, rounds, depth, rate, bins=bins)
    return boosting.boost(train, label, weight, settings, folder)


def linear_regression(train: DataFrame, label: str):
    """Ordinary least squares by the normal equations, solved once."""
    return LinearRegression(featuresCol="features", labelCol=label, regParam=0.0, solver="normal").fit(train)


def boosted_regressor(
    train: DataFrame,
    label: str,
    rounds: int = 300,
    depth: int = 3,
    rate: float = 0.05,
    bins: int = boosting.MOST_BINS,
    folder: str | None = None,
) -> BoostedTrees:
    """Boosted trees on the squared loss: leaves are plain means of residuals, one row is enough for one."""
    settings = boosting.Settings(boosting.SQUARED, rounds, depth, rate, penalty=0.0, bins=bins)
    return boosting.boost(train, label, None, settings, folder)


_MODEL_COLUMNS = ("prediction", "rawPrediction", "probability")


def add_probability(model, table: DataFrame, name: str) -> DataFrame:
    """Add the class 1 probability under `name`."""
    if isinstance(model, BoostedTrees):
        return table.withColumn(name, model.score())
    scored = model.transform(table).withColumn(name, vector_to_array("probability")[1])
    return scored.drop(*_MODEL_COLUMNS)


def add_prediction(model, table: DataFrame, name: str) -> DataFrame:
    """Add the predicted value under `name`."""
    if isinstance(model, BoostedTrees):
        return table.withColumn(name, model.score())
    scored = model.transform(table).withColumn(name, F.col("prediction"))
    return scored.drop(*_MODEL_COLUMNS)
