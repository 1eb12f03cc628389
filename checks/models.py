"""Learners, whole model runs and explanations. SQL cannot say their values; it says properties of them.

They train at the published sizes: 1,000 iterations at most, 300 trees, 300 rounds.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from checks.evaluation import HASH
from checks.registry import query, sql
from custoria.operators import evaluation
from custoria.plans import churn, spend
from custoria.sources import star

CHURN = churn.ChurnSettings()
SPEND = spend.SpendSettings()


@lru_cache(maxsize=8)
def _churn(application: str, spark, folder: str) -> churn.ChurnRun:
    return churn.run_churn(star.shop(spark, folder), CHURN)


@lru_cache(maxsize=8)
def _spend(application: str, spark, folder: str) -> spend.SpendRun:
    return spend.run_spend(star.shop(spark, folder), SPEND)


def churn_run(spark, folder):
    return _churn(spark.sparkContext.applicationId, spark, folder)


def spend_run(spark, folder):
    return _spend(spark.sparkContext.applicationId, spark, folder)


def scores_of(spark, folder, model):
    return churn_run(spark, folder).scores.filter(F.col("model") == model)


# Each trained operator states properties that SQL can state as well, on the rows of its real run: which rows are scored,
# that probabilities are probabilities, that equations of the optimum hold, that parts add up. They are not the values.
TEST_ROWS = "SELECT customer_id, churned AS label FROM part_of WHERE is_test"
SPEND_ROWS = f"SELECT customer_id, future_90d_spend AS label FROM clv WHERE {HASH} < {2**58}"
CHURN_MODELS, SPEND_MODELS = (churn.LOGISTIC, churn.FOREST, churn.BOOSTED), (spend.LINEAR, spend.BOOSTED)


def scored_sql(source: str, rows: str, models, value: str) -> str:
    parts = (f"SELECT customer_id, label, '{m}' AS model, TRUE AS {value} FROM ({rows})" for m in models)
    return sql(source, " UNION ALL ".join(parts))


def names_sql(models) -> str:
    return " UNION ALL ".join(f"SELECT '{m}' AS model" for m in models)


def probabilities(scores):
    sound = F.col("prob").between(0.0, 1.0) & ~F.isnan("prob")
    return scores.select("customer_id", "label", "model", sound.alias("is_probability"))


def amounts(scores):
    sound = F.col("prediction").isNotNull() & ~F.isnan("prediction") & (F.abs("prediction") < float("inf"))
    return scores.select("customer_id", "label", "model", sound.alias("is_finite"))


@query("L01_logistic_regression", scored_sql("part_of", TEST_ROWS, CHURN_MODELS[:1], "is_probability"))
def l01(spark, folder):
    return probabilities(scores_of(spark, folder, churn.LOGISTIC))


@query("L01_gradient", "SELECT CAST(0 AS BIGINT) AS slopes_off, TRUE AS settled FROM customer LIMIT 1")
def l01_gradient(spark, folder):
    """The penalised loss is flat at the fit: per feature and for the intercept, over the train rows."""
    run = churn_run(spark, folder)
    model, train = run.models[churn.LOGISTIC], run.prepared.train
    total = train.agg(F.sum("balanced")).first()[0]
    scored = model.transform(train).withColumn("error", F.col("balanced") * (vector_to_array("probability")[1] - F.col(churn.LABEL)))
    weights = model.coefficients.toArray().tolist()
    x = vector_to_array("scaled")
    sums = scored.agg(F.sum("error").alias("b"), *[F.sum(F.col("error") * x[i]).alias(f"g{i}") for i in range(len(weights))])
    slopes = F.array(F.col("b") / total, *[(F.col(f"g{i}") + w) / total for i, w in enumerate(weights)])
    off = F.size(F.filter(slopes, lambda g: F.abs(g) > 1e-4)).cast("bigint")
    return sums.select(off.alias("slopes_off"), F.lit(model.summary.totalIterations < CHURN.max_iter).alias("settled"))


@query("L02_random_forest", scored_sql("part_of", TEST_ROWS, CHURN_MODELS[1:2], "is_probability"))
def l02(spark, folder):
    return probabilities(scores_of(spark, folder, churn.FOREST))


@query("L03_boosted_classifier", scored_sql("part_of", TEST_ROWS, CHURN_MODELS[2:], "is_probability"))
def l03(spark, folder):
    return probabilities(scores_of(spark, folder, churn.BOOSTED))


@query("L04_linear_regression", scored_sql("clv", SPEND_ROWS, SPEND_MODELS[:1], "is_finite"))
def l04(spark, folder):
    return amounts(spend_run(spark, folder).scores.filter(F.col("model") == spend.LINEAR))


@query("L04_normal_equations", "SELECT CAST(0 AS BIGINT) AS equations_off FROM customer LIMIT 1")
def l04_equations(spark, folder):
    """Residuals of the train rows are orthogonal to every feature and to the constant."""
    run = spend_run(spark, folder)
    scored = run.models[spend.LINEAR].transform(run.prepared.train)
    error, x = F.col(SPEND.label) - F.col("prediction"), vector_to_array("features")
    names = run.prepared.design.names
    sums = scored.agg(
        F.sum(error).alias("b"),
        F.sum(F.abs(error)).alias("size"),
        *[F.sum(error * x[i]).alias(f"g{i}") for i in range(len(names))],
        *[F.sum(F.abs(error * x[i])).alias(f"s{i}") for i in range(len(names))],
    )
    shares = F.array(F.col("b") / F.col("size"), *[F.try_divide(f"g{i}", f"s{i}") for i in range(len(names))])
    return sums.select(F.size(F.filter(shares, lambda s: F.abs(s) > 1e-6)).cast("bigint").alias("equations_off"))


@query("L05_boosted_regressor", scored_sql("clv", SPEND_ROWS, SPEND_MODELS[1:], "is_finite"))
def l05(spark, folder):
    return amounts(spend_run(spark, folder).scores.filter(F.col("model") == spend.BOOSTED))


@query(
    "L06_scores",
    scored_sql("part_of", "SELECT customer_id, churned AS label FROM part_of", CHURN_MODELS, "is_probability"),
)
def l06(spark, folder):
    run = churn_run(spark, folder)
    return probabilities(churn.score(run.models, run.prepared.table))


@query("L03_stage_loss", f"SELECT CAST(range + 1 AS INT) AS round, TRUE AS falls, TRUE AS gains FROM range({CHURN.rounds})")
def l03_losses(spark, folder):
    """Every round lowers the loss of the train rows, and the last lies below that of the best constant."""
    return falling(spark, churn_run(spark, folder).models[churn.BOOSTED])


@query("L05_stage_loss", f"SELECT CAST(range + 1 AS INT) AS round, TRUE AS falls, TRUE AS gains FROM range({SPEND.rounds})")
def l05_losses(spark, folder):
    return falling(spark, spend_run(spark, folder).models[spend.BOOSTED])


def falling(spark, model):
    losses = model.losses
    rows = [(at, after < before, after < losses[0]) for at, (before, after) in enumerate(zip(losses, losses[1:]), 1)]
    return spark.createDataFrame(rows, "round int, falls boolean, gains boolean")


@query("L06_train_auc", names_sql(CHURN_MODELS).replace("AS model", "AS model, TRUE AS above_recency"))
def l06_auc(spark, folder):
    """On its train rows every model ranks better than days since the last order; a constant one would not."""
    run = churn_run(spark, folder)
    place = run.prepared.design.names.index("recency_days")
    recency = vector_to_array("features")[place] / (vector_to_array("features")[place] + 90)
    plain = run.prepared.train.select("customer_id", F.col(churn.LABEL).alias("label"), F.lit("recency").alias("model"), recency.alias("prob"))
    scores = churn.score(run.models, run.prepared.train)
    table = evaluation.compare_classifiers(scores.unionByName(plain.select(*scores.columns)))
    least = table.filter("model = 'recency'").select("roc_auc").scalar()
    return table.filter("model <> 'recency'").select("model", (F.col("roc_auc") > least).alias("above_recency"))


@query("L06_train_error", "SELECT TRUE AS below_linear, TRUE AS below_mean FROM customer LIMIT 1")
def l06_error(spark, folder):
    """On the train rows boosting explains more of the spend than the line, and the line more than the mean."""
    run = spend_run(spark, folder)
    table = evaluation.regression_errors(spend.score(run.models, run.prepared.train, SPEND.label))
    r2 = {name: F.max(F.when(F.col("model") == name, F.col("r2"))) for name in SPEND_MODELS}
    return table.agg((r2[spend.BOOSTED] > r2[spend.LINEAR]).alias("below_linear"), (r2[spend.LINEAR] > 0).alias("below_mean"))


def importance_sum(table):
    return table.agg(F.round(F.sum("importance"), 6).alias("total"), F.count_if(F.col("importance") < 0).alias("negative"))


SUM_SQL = "SELECT CAST(1 AS DOUBLE) AS total, CAST(0 AS BIGINT) AS negative FROM customer LIMIT 1"


@query("E10_feature_importance", SUM_SQL)
def e10(spark, folder):
    run = churn_run(spark, folder)
    return importance_sum(run.forest_importance(len(run.prepared.design.names)))


@query("E10_spend_importance", SUM_SQL)
def e10_spend(spark, folder):
    run = spend_run(spark, folder)
    return importance_sum(run.importance(len(run.prepared.design.names)))


@query("E11_attributions", "SELECT 12 AS features, TRUE AS ordered FROM customer LIMIT 1")
def e11(spark, folder):
    top = churn_run(spark, folder).top_attributions(12)
    ranked = top.agg(F.collect_list("mean_abs").alias("m"))
    return ranked.select(F.size("m").alias("features"), (F.col("m") == F.reverse(F.array_sort("m"))).alias("ordered"))


@query("E11_attribution_rows", sql("part_of", "SELECT customer_id, TRUE AS adds_up FROM part_of WHERE is_test"))
def e11_rows(spark, folder):
    """Attributions and base add up to the margin, which the probability tells."""
    run = churn_run(spark, folder)
    margin = F.aggregate("phi", F.col("base"), lambda a, x: a + x)
    told = run.scores.filter(F.col("model") == churn.BOOSTED).select("customer_id", "prob")
    meant = 1 / (1 + F.exp(-margin))
    return run.attributions().join(told, "customer_id").select("customer_id", (F.abs(meant - F.col("prob")) < 1e-6).alias("adds_up"))


@query(
    "Q08_churn_models",
    sql("part_of", f"SELECT model, TRUE AS in_range, count(*) AS tested FROM part_of, ({names_sql(CHURN_MODELS)}) WHERE is_test GROUP BY 1"),
)
def q08(spark, folder):
    run = churn_run(spark, folder)
    cells = evaluation.confusion(evaluation.outcome_counts(run.scores)).groupBy("model").agg(F.sum("n").alias("tested"))
    fits = [F.col(m).between(0.0, 1.0) | F.col(m).isNull() for m in ("roc_auc", "precision", "recall", "f1")]
    return run.comparison().join(cells, "model").select("model", (fits[0] & fits[1] & fits[2] & fits[3]).alias("in_range"), "tested")


@query("Q08_roc_points", names_sql(CHURN_MODELS).replace("AS model", "AS model, TRUE AS spans_the_square"))
def q08_roc(spark, folder):
    ends = churn_run(spark, folder).roc().groupBy("model").agg(
        (F.min("fpr") + F.min("tpr") == 0).alias("low"), ((F.max("fpr") == 1) & (F.max("tpr") == 1)).alias("high")
    )
    return ends.select("model", (F.col("low") & F.col("high")).alias("spans_the_square"))


@query(
    "Q08_class_report",
    sql("part_of", f"SELECT model, CAST(churned AS VARCHAR) AS class, count(*) AS support FROM part_of, ({names_sql(CHURN_MODELS)}) WHERE is_test GROUP BY 1, 2"),
)
def q08_report(spark, folder):
    return churn_run(spark, folder).report().filter(F.col("class").isin("0", "1")).select("model", "class", "support")


@query("Q08_best_confusion", sql("part_of", "SELECT churned AS actual, count(*) AS n FROM part_of WHERE is_test GROUP BY 1"))
def q08_best(spark, folder):
    return churn_run(spark, folder).best_confusion().groupBy("actual").agg(F.sum("n").alias("n"))


@query(
    "Q09_spend_models",
    sql("clv", f"SELECT model, TRUE AS in_range, count(*) AS tested FROM ({SPEND_ROWS}), ({names_sql(SPEND_MODELS)}) GROUP BY 1"),
)
def q09(spark, folder):
    run = spend_run(spark, folder)
    tested = run.scores.groupBy("model").agg(F.count(F.lit(1)).alias("tested"))
    return run.comparison().join(tested, "model").select("model", ((F.col("mae") >= 0) & (F.col("r2") <= 1)).alias("in_range"), "tested")


@query("Q09_best_pairs", sql("clv", SPEND_ROWS))
def q09_pairs(spark, folder):
    return spend_run(spark, folder).best_pairs().select("customer_id", "label")
