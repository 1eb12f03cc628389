"""Train, score, compare and explain the churn models."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from custoria.operators import evaluation, explain, learners, matrix
from custoria.operators.features import churn_features
from custoria.operators.horizon import horizon, last_date
from custoria.operators.reshape import top_rows
from custoria.operators.splits import stratified_split
from custoria.sources.readers import Shop
from custoria.sources.reuse import settle

LABEL = "churned"
# The model names and sizes of the published comparison.
LOGISTIC, FOREST, BOOSTED = "Logistic Regression", "Random Forest", "Boosted Trees"


@dataclass(frozen=True)
class ChurnSettings:
    window_days: int = 90
    categories: tuple[str, ...] = matrix.CHURN_CATEGORIES
    max_iter: int = 1000
    trees: int = 300
    tree_depth: int = 6
    rounds: int = 300
    rate: float = 0.05
    seed: int = 42
    as_of: dt.date | str | None = None
    #: A lasting shared folder: a run that was cut off goes on from what its boosting saved there.
    resume: str | None = None

    @staticmethod
    def interactive(window_days: int = 90, **changes) -> ChurnSettings:
        """The variant of the interactive page: fewer categories, shorter and faster boosting."""
        wanted = dict(categories=matrix.SHORT_CATEGORIES, trees=200, rounds=200, rate=0.08)
        return ChurnSettings(window_days=window_days, **{**wanted, **changes})


@dataclass(frozen=True)
class Prepared:
    """The settled training table: keys, label, `is_test`, weights and both vectors."""

    table: DataFrame
    design: matrix.Design

    @property
    def train(self) -> DataFrame:
        return self.table.filter(~F.col("is_test"))

    @property
    def test(self) -> DataFrame:
        return self.table.filter("is_test")


@dataclass(frozen=True)
class ChurnRun:
    features: DataFrame
    prepared: Prepared
    models: dict
    scores: DataFrame

    def comparison(self) -> DataFrame:
        return evaluation.compare_classifiers(self.scores, digits=3)

    def report(self) -> DataFrame:
        return evaluation.classification_report(evaluation.outcome_counts(self.scores))

    def roc(self) -> DataFrame:
        return evaluation.roc_curve(self.scores)

    def best_confusion(self) -> DataFrame:
        best = evaluation.best_classifier(evaluation.compare_classifiers(self.scores))
        cells = evaluation.confusion(evaluation.outcome_counts(self.scores))
        return cells.join(F.broadcast(best.select("model")), "model", "left_semi")  # one row

    def forest_importance(self, k: int = 10) -> DataFrame:
        spark = self.scores.sparkSession
        ranked = explain.importances(spark, self.models[FOREST], self.prepared.design.named(spark))
        return top_rows(ranked, "importance", "feature", k)

    def attributions(self) -> DataFrame:
        names = self.prepared.design.names
        return explain.attributions(self.prepared.test, self.models[BOOSTED], names, ["customer_id"])

    def top_attributions(self, k: int = 12) -> DataFrame:
        ranked = explain.ranked_attributions(self.attributions(), self.prepared.design.names)
        return top_rows(ranked, "mean_abs", "feature", k)


def feature_table(shop: Shop, settings: ChurnSettings = ChurnSettings()) -> DataFrame:
    span = horizon(shop.orders, settings.window_days, settings.as_of or last_date(shop.orders))
    payment = "preferred_payment" in settings.categories
    return churn_features(shop.customers, shop.orders, shop.order_items, span, payment)


def prepare(features: DataFrame, settings: ChurnSettings = ChurnSettings()) -> Prepared:
    """Split, weigh, scale and assemble a saved feature table. The result is written once, since
    learners read it up to hundreds of times and a lost executor must not rebuild it."""
    columns = ["customer_id", LABEL, *matrix.CHURN_NUMERIC, *settings.categories]
    split = settle(stratified_split(features.select(*columns), "customer_id", LABEL, seed=settings.seed), "split")
    train = split.filter(~F.col("is_test"))
    design = matrix.Design.fit(split, matrix.CHURN_NUMERIC, settings.categories)
    scaler = design.fit_scaler(train)
    weighted = matrix.positive_weights(matrix.balanced_weights(split, train, LABEL), train, LABEL)
    keep = ["customer_id", LABEL, "is_test", "balanced", "positive_weight"]
    return Prepared(settle(design.assemble(weighted, keep, scaler), "churn-matrix"), design)


def train_models(prepared: Prepared, settings: ChurnSettings = ChurnSettings()) -> dict:
    train = prepared.train
    total = train.agg(F.sum("balanced")).first()[0]
    return {
        LOGISTIC: learners.logistic_regression(train, LABEL, "balanced", total, settings.max_iter),
        FOREST: learners.random_forest(
            train, LABEL, "balanced", settings.trees, settings.tree_depth, settings.seed
        ),
        BOOSTED: learners.boosted_classifier(
            train, LABEL, "positive_weight", settings.rounds, rate=settings.rate, folder=settings.resume
        ),
    }


def score(models: dict, table: DataFrame) -> DataFrame:
    """Long score table (customer_id, label, model, prob), every model in one pass."""
    columns = {}
    for place, (name, model) in enumerate(models.items()):
        columns[name] = f"prob_{place}"
        table = learners.add_probability(model, table, columns[name])
    return evaluation.long_scores(table, columns, LABEL, ["customer_id"])


def run_churn(shop: Shop, settings: ChurnSettings = ChurnSettings()) -> ChurnRun:
    """Features, split, three models and their test scores; every step's table is written once."""
    features = settle(feature_table(shop, settings), "churn-features")
    prepared = prepare(features, settings)
    models = train_models(prepared, settings)
    return ChurnRun(features, prepared, models, settle(score(models, prepared.test), "churn-scores"))
