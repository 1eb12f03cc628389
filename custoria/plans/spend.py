"""Train, score and compare the models of next-window spend."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from custoria.functions.columns import as_double
from custoria.operators import evaluation, explain, learners, matrix
from custoria.operators.features import spend_features
from custoria.operators.horizon import horizon, last_date
from custoria.operators.reshape import top_rows
from custoria.operators.splits import random_split
from custoria.plans.churn import Prepared
from custoria.sources.readers import Shop
from custoria.sources.reuse import settle

LINEAR, BOOSTED = "Linear Regression", "Gradient Boosting"


@dataclass(frozen=True)
class SpendSettings:
    window_days: int = 90
    categories: tuple[str, ...] = matrix.SPEND_CATEGORIES
    rounds: int = 300
    rate: float = 0.05
    seed: int = 42
    as_of: dt.date | str | None = None
    #: A lasting shared folder: a run that was cut off goes on from what its boosting saved there.
    resume: str | None = None

    @property
    def label(self) -> str:
        return f"future_{self.window_days}d_spend"

    @staticmethod
    def interactive(**changes) -> SpendSettings:
        """The variant of the interactive page."""
        wanted = dict(categories=matrix.SHORT_CATEGORIES, rounds=200, rate=0.08)
        return SpendSettings(**{**wanted, **changes})


@dataclass(frozen=True)
class SpendRun:
    prepared: Prepared
    models: dict
    scores: DataFrame

    def comparison(self) -> DataFrame:
        return evaluation.regression_errors(self.scores, digits=(2, 3))

    def best_pairs(self) -> DataFrame:
        """Actual and predicted spend of the best model."""
        best = evaluation.best_regressor(evaluation.regression_errors(self.scores))
        return self.scores.join(F.broadcast(best.select("model")), "model", "left_semi")  # one row

    def importance(self, k: int = 10) -> DataFrame:
        spark = self.scores.sparkSession
        ranked = explain.importances(spark, self.models[BOOSTED], self.prepared.design.named(spark))
        return top_rows(ranked, "importance", "feature", k)


def feature_table(shop: Shop, settings: SpendSettings = SpendSettings()) -> DataFrame:
    span = horizon(shop.orders, settings.window_days, settings.as_of or last_date(shop.orders))
    return spend_features(shop.customers, shop.orders, span)


def prepare(features: DataFrame, settings: SpendSettings = SpendSettings()) -> Prepared:
    columns = ["customer_id", settings.label, *matrix.SPEND_NUMERIC, *settings.categories]
    split = settle(random_split(features.select(*columns), "customer_id", seed=settings.seed), "split")
    design = matrix.Design.fit(split, matrix.SPEND_NUMERIC, settings.categories)
    matrix_rows = design.assemble(split, ["customer_id", settings.label, "is_test"])
    return Prepared(settle(matrix_rows, "spend-matrix"), design)


def train_models(prepared: Prepared, settings: SpendSettings = SpendSettings()) -> dict:
    return {
        LINEAR: learners.linear_regression(prepared.train, settings.label),
        BOOSTED: learners.boosted_regressor(
            prepared.train, settings.label, settings.rounds, rate=settings.rate, folder=settings.resume
        ),
    }


def score(models: dict, table: DataFrame, label: str) -> DataFrame:
    """Long table (customer_id, label, model, prediction), every model in one pass."""
    columns = {}
    for place, (name, model) in enumerate(models.items()):
        columns[name] = f"value_{place}"
        table = learners.add_prediction(model, table, columns[name])
    renamed = table.select(
        "customer_id", as_double(label).alias("label"), *[F.col(c).alias(n) for n, c in columns.items()]
    )
    return renamed.unpivot(["customer_id", "label"], list(columns), "model", "prediction")


def run_spend(shop: Shop, settings: SpendSettings = SpendSettings()) -> SpendRun:
    """Features, split, both models and their test scores."""
    prepared = prepare(feature_table(shop, settings), settings)
    models = train_models(prepared, settings)
    return SpendRun(prepared, models, settle(score(models, prepared.test, settings.label), "spend-scores"))
