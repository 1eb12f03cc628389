"""Exact evaluation of score tables: (model, label, prob) and (model, label, prediction).

All models are evaluated together, in one pass over the long table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from custoria.functions.columns import as_double, ratio
from custoria.operators.bounds import sized
from custoria.sources.reuse import settle
from custoria.operators.ordered import running_totals
from custoria.operators.reshape import best_row

THRESHOLD = 0.5
_WIDE = "decimal(38,0)"


def long_scores(wide: DataFrame, models: dict[str, str], label: str, keys: list[str] | None = None) -> DataFrame:
    """One row per model and scored row, from one score column per model."""
    keys = keys or []
    renamed = wide.select(
        *keys, F.col(label).alias("label"), *[as_double(c).alias(name) for name, c in models.items()]
    )
    return renamed.unpivot([*keys, "label"], list(models), "model", "prob")


def decide(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Add the 0/1 prediction."""
    return scores.withColumn("predicted", (F.col("prob") >= threshold).cast("int"))


def outcome_counts(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """True and false positives and negatives per model."""
    positive, called = F.col("label") == 1, F.col("prob") >= threshold
    return scores.groupBy("model").agg(
        F.count_if(positive & called).alias("tp"),
        F.count_if(~positive & called).alias("fp"),
        F.count_if(positive & ~called).alias("fn"),
        F.count_if(~positive & ~called).alias("tn"),
    )


def _f1(hit: str, wrong: str, missed: str):
    return ratio(F.col(hit) * 2, F.col(hit) * 2 + F.col(wrong) + F.col(missed))


def precision_recall(counts: DataFrame, zero_division: float | None = None) -> DataFrame:
    """Precision, recall and F1 of class 1; `zero_division`, by default null, where undefined."""
    other = F.lit(zero_division).cast("double")
    return counts.select(
        "model",
        F.coalesce(ratio("tp", F.col("tp") + F.col("fp")), other).alias("precision"),
        F.coalesce(ratio("tp", F.col("tp") + F.col("fn")), other).alias("recall"),
        F.coalesce(_f1("tp", "fp", "fn"), other).alias("f1"),
    )


def confusion(counts: DataFrame) -> DataFrame:
    """Actual x predicted with all four cells, empty ones as zero."""
    return counts.selectExpr(
        "model", "stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) as (actual, predicted, n)"
    )


def classification_report(counts: DataFrame) -> DataFrame:
    """Per class, accuracy, macro and weighted averages; one set of lines per model.

    An undefined class value is null and counts as zero in the averages.
    """
    by_class = counts.selectExpr(
        "model", "stack(2, '0', tn, fn, fp, '1', tp, fp, fn) as (class, hit, wrong, missed)"
    ).select(
        "model",
        "class",
        ratio("hit", F.col("hit") + F.col("wrong")).alias("precision"),
        ratio("hit", F.col("hit") + F.col("missed")).alias("recall"),
        _f1("hit", "wrong", "missed").alias("f1"),
        (F.col("hit") + F.col("missed")).alias("support"),
        "hit",
    )
    measures = ("precision", "recall", "f1")
    total = F.sum("support")
    averages = by_class.groupBy("model").agg(
        *[F.avg(F.coalesce(m, F.lit(0.0))).alias(f"macro_{m}") for m in measures],
        *[
            ratio(F.sum(F.coalesce(m, F.lit(0.0)) * F.col("support")), total).alias(f"weighted_{m}")
            for m in measures
        ],
        ratio(F.sum("hit"), total).alias("accuracy"),
        total.alias("support"),
    )
    lines = averages.selectExpr(
        "model",
        "stack(3, 'accuracy', accuracy, accuracy, accuracy, support,"
        " 'macro avg', macro_precision, macro_recall, macro_f1, support,"
        " 'weighted avg', weighted_precision, weighted_recall, weighted_f1, support)"
        " as (class, precision, recall, f1, support)",
    )
    return by_class.drop("hit").unionByName(lines)


def score_points(scores: DataFrame) -> DataFrame:
    """Positives and negatives per distinct score: repeated scores are merged before any order."""
    return scores.groupBy("model", "prob").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )


def ranked_points(scores: DataFrame) -> DataFrame:
    """Score points with cumulative positives and negatives from the highest score down.

    The points are saved first: the running totals read them three times.
    """
    return running_totals(settle(score_points(scores), "points"), "model", "prob", {"pos": "cum_pos", "neg": "cum_neg"})


def average_ranks(scores: DataFrame) -> DataFrame:
    """Ascending rank of every distinct score, ties sharing their average."""
    points = settle(score_points(scores).withColumn("n", F.col("pos") + F.col("neg")), "points")
    total = points.groupBy("model").agg(F.sum("n").alias("rows"))
    ranked = running_totals(points, "model", "prob", {"n": "down_to"})
    below = F.col("rows") - F.col("down_to")
    return ranked.join(sized(total), "model").select(
        "model", "prob", "n", (as_double(below) + (F.col("n") + 1) / F.lit(2.0)).alias("avg_rank")
    )


def roc_auc(scores: DataFrame) -> DataFrame:
    """Area under the ROC curve, exact, a tie counting one half; null if a class is empty."""
    wins = F.col("neg").cast("decimal(18,0)") * (2 * F.col("cum_pos") - F.col("pos")).cast("decimal(19,0)")
    return (
        ranked_points(scores)
        .groupBy("model")
        .agg(
            F.sum(wins.cast(_WIDE)).alias("wins"),
            F.sum("pos").alias("positives"),
            F.sum("neg").alias("negatives"),
        )
        .select(
            "model",
            F.try_divide(
                as_double("wins"), 2 * as_double("positives") * as_double("negatives")
            ).alias("roc_auc"),
        )
    )


def roc_curve(scores: DataFrame) -> DataFrame:
    """False and true positive rate at every distinct threshold, plus the origin (null threshold)."""
    points = settle(score_points(scores), "points")
    ranked = running_totals(points, "model", "prob", {"pos": "cum_pos", "neg": "cum_neg"})
    totals = sized(
        points.groupBy("model")
        .agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    )
    origin = totals.select(
        "model", F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    curve = ranked.join(totals, "model").select(
        "model",
        F.col("prob").alias("threshold"),
        ratio("cum_neg", "negatives").alias("fpr"),
        ratio("cum_pos", "positives").alias("tpr"),
    )
    return curve.unionByName(origin)


def compare_classifiers(
    scores: DataFrame, threshold: float = THRESHOLD, digits: int | None = None, zero_division: float | None = None
) -> DataFrame:
    """One line per model: ROC AUC, precision, recall, F1 (undefined ones as `zero_division`)."""
    quality = precision_recall(outcome_counts(scores, threshold), zero_division)
    table = roc_auc(scores).join(quality, "model")
    measures = ("roc_auc", "precision", "recall", "f1")
    return table.select("model", *[_rounded(m, digits) for m in measures])


def best_classifier(comparison: DataFrame) -> DataFrame:
    return best_row(comparison, "roc_auc", "model")


def regression_errors(scores: DataFrame, digits: tuple[int, int] | None = None) -> DataFrame:
    """Mean absolute error and R2 per model over (model, label, prediction)."""
    error = F.col("label") - F.col("prediction")
    totals = scores.groupBy("model").agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sum(error * error).alias("residual"),
        (F.var_pop("label") * F.count("label")).alias("spread"),
    )
    mae, r2 = digits or (None, None)
    return totals.withColumn("r2", 1 - F.try_divide("residual", "spread")).select(
        "model", _rounded("mae", mae), _rounded("r2", r2)
    )


def best_regressor(comparison: DataFrame) -> DataFrame:
    return best_row(comparison, "r2", "model")


def axis_limit(scores: DataFrame) -> DataFrame:
    """Largest actual or predicted value per model."""
    return scores.groupBy("model").agg(F.max(F.greatest("label", "prediction")).alias("axis_max"))


def _rounded(name: str, digits: int | None):
    return F.col(name) if digits is None else F.round(name, digits).alias(name)
