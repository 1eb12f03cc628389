"""Splits, scaling, weights and evaluation, on score tables that need no model."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from checks.registry import query, sql, view
from custoria.functions.columns import as_double
from custoria.operators import evaluation, features, matrix, ordered, reshape, splits
from custoria.operators.bounds import sized
from custoria.operators.horizon import horizon
from custoria.sources import star
from custoria.sources.reuse import ResultStore

HASH = "CAST('0x' || substr(md5('42:' || CAST(customer_id AS VARCHAR)), 1, 15) AS BIGINT)"

view(
    "score",
    "feat",
    text="""
    SELECT 'recency' AS model, customer_id, churned AS label,
           CAST(recency_days AS DOUBLE) / (CAST(recency_days AS DOUBLE) + 90) AS prob FROM feat
    UNION ALL
    SELECT 'orders', customer_id, churned, CAST(1 AS DOUBLE) / (CAST(1 AS DOUBLE) + total_orders) FROM feat""",
)
view(
    "outcome",
    "score",
    text="""
    SELECT model, count(*) FILTER (label = 1 AND prob >= 0.5) AS tp,
           count(*) FILTER (label = 0 AND prob >= 0.5) AS fp, count(*) FILTER (label = 1 AND prob < 0.5) AS fn,
           count(*) FILTER (label = 0 AND prob < 0.5) AS tn
    FROM score GROUP BY model""",
)
view(
    "point",
    "score",
    text="""
    SELECT model, prob, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
    FROM score GROUP BY model, prob""",
)
view(
    "ranked",
    "point",
    text="""
    SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS cum_pos, CAST(sum(neg) OVER w AS BIGINT) AS cum_neg
    FROM point WINDOW w AS (PARTITION BY model ORDER BY prob DESC)""",
)
view(
    "auc",
    "ranked",
    text="""
    SELECT model, CAST(sum(CAST(neg AS HUGEINT) * (2 * cum_pos - pos)) AS DOUBLE)
                  / nullif(2 * CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE), 0) AS roc_auc
    FROM ranked GROUP BY model""",
)
view(
    "quality",
    "outcome",
    text="""
    SELECT model, CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS "precision", CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS recall,
           CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0) AS f1
    FROM outcome""",
)
view(
    "forecast",
    "clv",
    text="""
    SELECT 'rate' AS model, customer_id, future_90d_spend AS label, avg_order_value * order_frequency * 3 AS prediction FROM clv
    UNION ALL SELECT 'zero', customer_id, future_90d_spend, CAST(0 AS DOUBLE) FROM clv""",
)
view(
    "error",
    "forecast",
    text="""
    SELECT model, avg(abs(label - prediction)) AS mae,
           1 - sum((label - prediction) * (label - prediction)) / (var_pop(label) * count(*)) AS r2
    FROM forecast GROUP BY model""",
)


def feature_table(spark, folder):
    """The customer feature table, saved on first use: splits and evaluations read it repeatedly."""

    def build():
        shop = star.shop(spark, folder)
        return features.churn_features(shop.customers, shop.orders, shop.order_items, horizon(shop.orders))

    return ResultStore(spark).get("features", build, folder=folder)


def scores(spark, folder):
    """Two scores per customer that follow from the features; the second has many ties."""

    def build():
        recency, orders = as_double("recency_days"), as_double("total_orders")
        wide = feature_table(spark, folder).select(
            "customer_id", "churned", (recency / (recency + 90)).alias("a"), (F.lit(1.0) / (1 + orders)).alias("b")
        )
        return evaluation.long_scores(wide, {"recency": "a", "orders": "b"}, "churned", ["customer_id"])

    return ResultStore(spark).get("scores", build, folder=folder)


def spend_table(spark, folder):
    def build():
        shop = star.shop(spark, folder)
        return features.spend_features(shop.customers, shop.orders, horizon(shop.orders))

    return ResultStore(spark).get("spend", build, folder=folder)


def forecasts(spark, folder):
    """Two spend predictions per customer that need no model."""
    table = spend_table(spark, folder).select(
        "customer_id",
        F.col("future_90d_spend").alias("label"),
        (F.col("avg_order_value") * F.col("order_frequency") * 3).alias("rate"),
        F.lit(0.0).alias("zero"),
    )
    return table.unpivot(["customer_id", "label"], ["rate", "zero"], "model", "prediction")


# ---- splits, scaling, weights, matrix -------------------------------------------------------

view(
    "class_size",
    "feat",
    text="SELECT churned, count(*) AS n, sum(count(*)) OVER () AS total FROM feat GROUP BY churned",
)
view(
    "quota",
    "class_size",
    text="""
    SELECT churned, whole + CAST(row_number() OVER (ORDER BY rest DESC, churned) <= wanted - sum(whole) OVER ()
                                 AS INTEGER) AS test_rows
    FROM (SELECT churned, ceil(total * 0.25) AS wanted, floor(n * ceil(total * 0.25) / total) AS whole,
                 n * ceil(total * 0.25) / total - floor(n * ceil(total * 0.25) / total) AS rest FROM class_size)""",
)
view(
    "part_of",
    "feat",
    "quota",
    text=f"""
    SELECT feat.*, row_number() OVER (PARTITION BY churned ORDER BY {HASH}, customer_id) <= test_rows AS is_test
    FROM feat JOIN quota USING (churned)""",
)


def split_table(spark, folder):
    """The stratified split, saved on first use: fits read its train rows, applications all of it."""

    def build():
        return splits.stratified_split(feature_table(spark, folder), "customer_id", "churned")

    return ResultStore(spark).get("split", build, folder=folder)


@query("M01_stratified_split", sql("part_of", "SELECT customer_id, churned, is_test FROM part_of"))
def m01(spark, folder):
    table = feature_table(spark, folder).select("customer_id", "churned")
    return splits.stratified_split(table, "customer_id", "churned")


@query(
    "M02_random_split",
    sql("clv", f"SELECT customer_id, {HASH} < {2**58} AS is_test FROM clv"),
)
def m02(spark, folder):
    table = spend_table(spark, folder)
    return splits.random_split(table, "customer_id").select("customer_id", "is_test")


@query(
    "M03_standardise",
    sql(
        "part_of",
        "SELECT customer_id, is_test, "
        + ", ".join(
            f"round((CAST({c} AS DOUBLE) - m_{c}) / s_{c}, 6) AS {c}" for c in matrix.CHURN_NUMERIC
        )
        + " FROM part_of, (SELECT "
        + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in matrix.CHURN_NUMERIC)
        + " FROM part_of WHERE NOT is_test)",
    ),
)
def m03(spark, folder):
    table = split_table(spark, folder)
    columns = {c: as_double(c) for c in matrix.CHURN_NUMERIC}
    scaler = matrix.Scaler.fit(table.filter(~F.col("is_test")), columns)
    return table.select(
        "customer_id", "is_test", *[F.round(scaler.scaled(n, v), 6).alias(n) for n, v in columns.items()]
    )


@query(
    "M04_feature_matrix",
    sql(
        "feat",
        "SELECT * FROM ("
        + " UNION ALL ".join(
            f"SELECT customer_id, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM feat" for c in matrix.CHURN_NUMERIC
        )
        + "".join(
            f" UNION ALL SELECT customer_id, '{c}_' || {c}, 1.0 FROM feat WHERE {c} > (SELECT min({c}) FROM feat)"
            for c in matrix.CHURN_CATEGORIES
        )
        + ") WHERE value <> 0",
    ),
)
def m04(spark, folder):
    table = feature_table(spark, folder)
    design = matrix.Design.fit(table, matrix.CHURN_NUMERIC, matrix.CHURN_CATEGORIES)
    vectors = design.assemble(table, ["customer_id"])
    names = F.array(*[F.lit(name) for name in design.names])
    cells = F.explode(F.arrays_zip(names.alias("feature"), vector_to_array("features").alias("value")))
    return (
        vectors.select("customer_id", cells.alias("cell"))
        .select("customer_id", F.col("cell.feature").alias("feature"), F.col("cell.value").alias("value"))
        .filter("value <> 0")
    )


@query(
    "M05_balanced_weight",
    sql(
        "part_of",
        """SELECT customer_id, churned, CAST(total AS DOUBLE) / (2 * n) AS balanced
        FROM part_of JOIN (SELECT churned, count(*) AS n, sum(count(*)) OVER () AS total
                           FROM part_of WHERE NOT is_test GROUP BY 1) USING (churned)""",
    ),
)
def m05(spark, folder):
    table = split_table(spark, folder)
    weighted = matrix.balanced_weights(table, table.filter(~F.col("is_test")), "churned")
    return weighted.select("customer_id", "churned", "balanced")


@query(
    "M06_positive_weight",
    sql(
        "part_of",
        """SELECT customer_id, churned, CASE WHEN churned = 1 THEN w ELSE 1 END AS positive_weight
        FROM part_of, (SELECT CAST(count(*) FILTER (churned = 0) AS DOUBLE)
                              / greatest(count(*) FILTER (churned = 1), 1) AS w FROM part_of WHERE NOT is_test)""",
    ),
)
def m06(spark, folder):
    table = split_table(spark, folder)
    weighted = matrix.positive_weights(table, table.filter(~F.col("is_test")), "churned")
    return weighted.select("customer_id", "churned", "positive_weight")


# ---- evaluation -----------------------------------------------------------------------------


@query(
    "P12_threshold",
    sql("score", "SELECT model, customer_id, label, prob, CAST(prob >= 0.5 AS INTEGER) AS predicted FROM score"),
)
def p12(spark, folder):
    return evaluation.decide(scores(spark, folder))


@query(
    "W02_average_rank",
    sql(
        "point",
        """SELECT model, prob, pos + neg AS n,
           CAST(sum(pos + neg) OVER (PARTITION BY model ORDER BY prob) AS DOUBLE) - (pos + neg) + (pos + neg + 1) / 2.0::DOUBLE
             AS avg_rank FROM point""",
    ),
)
def w02(spark, folder):
    return evaluation.average_ranks(scores(spark, folder))


@query("W03_cumulative_hits", sql("ranked", "SELECT * FROM ranked"))
def w03(spark, folder):
    return evaluation.ranked_points(scores(spark, folder))


@query("E01_roc_auc", sql("auc", "SELECT * FROM auc"))
def e01(spark, folder):
    return evaluation.roc_auc(scores(spark, folder))


@query("E02_precision_recall_f1", sql("quality", "SELECT * FROM quality"))
def e02(spark, folder):
    return evaluation.precision_recall(evaluation.outcome_counts(scores(spark, folder)))


view(
    "class_line",
    "outcome",
    text="""
    SELECT model, class, CAST(hit AS DOUBLE) / nullif(hit + wrong, 0) AS "precision",
           CAST(hit AS DOUBLE) / nullif(hit + missed, 0) AS recall,
           CAST(2 * hit AS DOUBLE) / nullif(2 * hit + wrong + missed, 0) AS f1, hit + missed AS support, hit
    FROM (SELECT model, '0' AS class, tn AS hit, fn AS wrong, fp AS missed FROM outcome
          UNION ALL SELECT model, '1', tp, fp, fn FROM outcome)""",
)


def rounded_report(source: str) -> str:
    return f"""
    SELECT model, class, round("precision", 9) AS "precision", round(recall, 9) AS recall, round(f1, 9) AS f1,
           CAST(support AS BIGINT) AS support FROM ({source})"""


def average_line(name: str, weight: str) -> str:
    parts = ", ".join(
        f"sum(coalesce({m}, 0) * {weight}) / sum(CAST({weight} AS DOUBLE))" for m in ('"precision"', "recall", "f1")
    )
    return f"SELECT model, '{name}', {parts}, sum(support) FROM class_line GROUP BY model"


@query(
    "E03_classification_report",
    sql(
        "class_line",
        rounded_report(
            f"""SELECT model, class, "precision", recall, f1, support FROM class_line
            UNION ALL SELECT model, 'accuracy', a, a, a, s
              FROM (SELECT model, sum(hit) / sum(CAST(support AS DOUBLE)) AS a, sum(support) AS s FROM class_line GROUP BY model)
            UNION ALL {average_line("macro avg", "1")}
            UNION ALL {average_line("weighted avg", "support")}"""
        ),
    ),
)
def e03(spark, folder):
    table = evaluation.classification_report(evaluation.outcome_counts(scores(spark, folder)))
    measures = [F.round(m, 9).alias(m) for m in ("precision", "recall", "f1")]
    return table.select("model", "class", *measures, "support")


@query(
    "E04_roc_curve",
    sql(
        "ranked",
        """SELECT model, prob AS threshold, CAST(cum_neg AS DOUBLE) / n AS fpr, CAST(cum_pos AS DOUBLE) / p AS tpr
        FROM ranked JOIN (SELECT model, sum(pos) AS p, sum(neg) AS n FROM ranked GROUP BY model) USING (model)
        UNION ALL SELECT DISTINCT model, NULL, 0, 0 FROM ranked""",
    ),
)
def e04(spark, folder):
    return evaluation.roc_curve(scores(spark, folder))


@query(
    "E05_confusion",
    sql(
        "outcome",
        """SELECT model, actual, predicted, CASE WHEN actual = 1 THEN CASE WHEN predicted = 1 THEN tp ELSE fn END
             ELSE CASE WHEN predicted = 1 THEN fp ELSE tn END END AS n
        FROM outcome, (SELECT unnest([0, 1]) AS actual), (SELECT unnest([0, 1]) AS predicted)""",
    ),
)
def e05(spark, folder):
    return evaluation.confusion(evaluation.outcome_counts(scores(spark, folder)))


@query("E06_model_comparison", sql("auc quality", "SELECT * FROM auc JOIN quality USING (model)"))
def e06(spark, folder):
    return evaluation.compare_classifiers(scores(spark, folder))


@query(
    "O02_best_model",
    sql("auc quality", "SELECT * FROM auc JOIN quality USING (model) ORDER BY roc_auc DESC, model LIMIT 1"),
)
def o02(spark, folder):
    return evaluation.best_classifier(evaluation.compare_classifiers(scores(spark, folder)))


@query("E07_mae_r2", sql("error", "SELECT model, round(mae, 6) AS mae, round(r2, 9) AS r2 FROM error"))
def e07(spark, folder):
    return evaluation.regression_errors(forecasts(spark, folder), digits=(6, 9))


@query(
    "E08_best_regressor",
    sql("error", "SELECT model, round(mae, 6) AS mae, round(r2, 9) AS r2 FROM error ORDER BY r2 DESC, model LIMIT 1"),
)
def e08(spark, folder):
    return evaluation.best_regressor(evaluation.regression_errors(forecasts(spark, folder), digits=(6, 9)))


@query(
    "E09_actual_vs_predicted",
    sql(
        "forecast",
        """SELECT model, customer_id, label, prediction, max(greatest(label, prediction)) OVER (PARTITION BY model) AS axis_max
        FROM forecast""",
    ),
)
def e09(spark, folder):
    pairs = forecasts(spark, folder)
    return pairs.join(sized(evaluation.axis_limit(pairs)), "model").select("model", "customer_id", "label", "prediction", "axis_max")


@query(
    "O03_top_k",
    sql("rfm", "SELECT customer_id, total_spend FROM rfm ORDER BY total_spend DESC, customer_id LIMIT 12"),
)
def o03(shop):
    spend = features.rfm(shop.orders, horizon(shop.orders)).select("customer_id", "total_spend")
    return reshape.top_rows(spend, "total_spend", "customer_id", 12)


@query(
    "W01_running_total_sliced",
    sql(
        "ord",
        """SELECT payment_method, order_value, CAST(sum(count(*)) OVER (PARTITION BY payment_method
             ORDER BY order_value DESC) AS BIGINT) AS orders_from_here_up
        FROM ord GROUP BY payment_method, order_value""",
    ),
)
def w01_sliced(shop):
    points = shop.orders.groupBy("payment_method", "order_value").agg(F.count(F.lit(1)).alias("n"))
    table = ordered.running_totals(points, "payment_method", "order_value", {"n": "orders_from_here_up"})
    return table.drop("n")
