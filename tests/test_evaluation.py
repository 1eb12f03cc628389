"""Evaluation, splits and matrix operators against small fixtures and brute force."""

import math
import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.sql import functions as F

from custoria.operators import evaluation, matrix, ordered, splits
from custoria.operators.reshape import best_row


def scored(spark, *rows, model="m"):
    return spark.createDataFrame([(model, label, float(p)) for p, label in rows], "model string, label int, prob double")


def test_auc_with_ties(spark):
    rows = zip((0.9, 0.8, 0.8, 0.3, 0.2, 0.1), (1, 0, 1, 0, 0, 1))
    assert evaluation.roc_auc(scored(spark, *rows)).first()["roc_auc"] == pytest.approx(11 / 18, abs=1e-15)


def test_auc_of_one_class_is_null(spark):
    assert evaluation.roc_auc(scored(spark, (0.5, 1), (0.7, 1))).first()["roc_auc"] is None


@pytest.mark.parametrize("hot", [0.0, 0.5])
def test_auc_equals_pair_counting_and_the_evaluator(spark, hot):
    """Also with half of all rows on one score."""
    rng = random.Random(7)
    rows = [(0.25 if rng.random() < hot else round(rng.random(), 4), rng.randint(0, 1)) for _ in range(1500)]
    table = scored(spark, *rows)
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    found = evaluation.roc_auc(table).first()["roc_auc"]
    assert found == pytest.approx(wins / len(pos) / len(neg), abs=1e-12)
    judge = BinaryClassificationEvaluator(rawPredictionCol="prob", labelCol="label", numBins=0)
    assert found == pytest.approx(judge.evaluate(table), abs=1e-9)


def test_running_totals_equal_a_plain_loop(spark):
    rng = random.Random(1)
    for low, high, n in ((0, 10**6, 3000), (0, 5, 4), (1, 1, 1)):
        values = {g: sorted({rng.uniform(low, high) ** 3 for _ in range(n)}, reverse=True) for g in "ab"}
        rows = [(g, v, rng.randint(0, 9), 1) for g in "ab" for v in values[g]]
        frame = spark.createDataFrame(rows, "g string, v double, x bigint, y bigint").repartition(5)
        table = ordered.running_totals(frame, "g", "v", {"x": "sx", "y": "sy"})
        found = {(r["g"], r["v"]): (r["sx"], r["sy"]) for r in table.collect()}
        assert len(found) == len(rows)
        for g in "ab":
            total = 0
            for place, (_, v, x, _) in enumerate((r for r in rows if r[0] == g), start=1):
                total += x
                assert found[g, v] == (total, place)


def test_average_ranks(spark):
    rows = [(p, 1) for p in (0.1, 0.2, 0.2, 0.2, 0.9)]
    found = {r["prob"]: r["avg_rank"] for r in evaluation.average_ranks(scored(spark, *rows)).collect()}
    assert found == {0.1: 1.0, 0.2: 3.0, 0.9: 5.0}


def test_roc_curve_is_monotone_and_spans_the_square(spark):
    rng = random.Random(3)
    rows = [(round(rng.random(), 2), rng.randint(0, 1)) for _ in range(400)]
    points = evaluation.roc_curve(scored(spark, *rows)).orderBy(F.desc_nulls_first("threshold")).collect()
    assert len(points) == len({p for p, _ in rows}) + 1
    assert (points[0]["fpr"], points[0]["tpr"], points[-1]["fpr"], points[-1]["tpr"]) == (0, 0, 1, 1)
    assert all(a["fpr"] <= b["fpr"] and a["tpr"] <= b["tpr"] for a, b in zip(points, points[1:]))
    area = sum((b["fpr"] - a["fpr"]) * (a["tpr"] + b["tpr"]) / 2 for a, b in zip(points, points[1:]))
    assert area == pytest.approx(evaluation.roc_auc(scored(spark, *rows)).first()["roc_auc"], abs=1e-12)


def test_nothing_predicted_positive(spark):
    counts = evaluation.outcome_counts(scored(spark, (0.1, 1), (0.2, 0)))
    row = evaluation.precision_recall(counts).first()
    assert (row["precision"], row["recall"], row["f1"]) == (None, 0.0, 0.0)
    cells = {(r["actual"], r["predicted"]): r["n"] for r in evaluation.confusion(counts).collect()}
    assert cells == {(0, 0): 1, (0, 1): 0, (1, 0): 1, (1, 1): 0}


def test_report_lines(spark):
    rows = [(0.9, 1)] * 6 + [(0.1, 1)] * 2 + [(0.8, 0)] * 1 + [(0.2, 0)] * 3
    lines = {r["class"]: r for r in evaluation.classification_report(evaluation.outcome_counts(scored(spark, *rows))).collect()}
    assert lines["1"]["precision"] == pytest.approx(6 / 7) and lines["1"]["recall"] == pytest.approx(6 / 8)
    assert lines["0"]["precision"] == pytest.approx(3 / 5) and lines["0"]["support"] == 4
    assert lines["accuracy"]["f1"] == pytest.approx(9 / 12)
    assert lines["macro avg"]["precision"] == pytest.approx((6 / 7 + 3 / 5) / 2)
    assert lines["weighted avg"]["recall"] == pytest.approx(9 / 12)
    p, r = lines["1"]["precision"], lines["1"]["recall"]
    assert lines["1"]["f1"] == pytest.approx(2 * p * r / (p + r))


def test_published_f1_follow_from_precision_and_recall(spark):
    """Counts with the published precision and recall give the published F1."""
    for p, r, f1 in ((0.986, 0.849, 0.912), (0.978, 0.871, 0.921), (0.979, 0.883, 0.928)):
        hits = 100_000
        counts = spark.createDataFrame([("m", hits, round(hits / p) - hits, round(hits / r) - hits, 5)], "model string, tp long, fp long, fn long, tn long")
        row = evaluation.precision_recall(counts).first()
        assert (row["precision"], row["recall"]) == (pytest.approx(p, abs=1e-5), pytest.approx(r, abs=1e-5))
        assert row["f1"] == pytest.approx(f1, abs=1.5e-3)


def test_undefined_measures_take_the_chosen_value(spark):
    counts = evaluation.outcome_counts(scored(spark, (0.1, 0), (0.2, 0)))
    assert evaluation.precision_recall(counts, 0.0).first()["precision"] == 0.0


def test_regression_errors_equal_the_evaluator(spark):
    rng = random.Random(5)
    rows = [("m", rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(500)]
    table = spark.createDataFrame(rows, "model string, label double, prediction double")
    row = evaluation.regression_errors(table).first()
    for name in ("mae", "r2"):
        judge = RegressionEvaluator(labelCol="label", predictionCol="prediction", metricName=name)
        assert row[name] == pytest.approx(judge.evaluate(table), abs=1e-9)
    flat = spark.createDataFrame([("m", 5.0, 4.0), ("m", 5.0, 6.0)], "model string, label double, prediction double")
    assert evaluation.regression_errors(flat).first()["r2"] is None
    assert evaluation.axis_limit(flat).first()["axis_max"] == 6.0


def test_best_model_and_ties(spark):
    table = spark.createDataFrame([("b", 0.9), ("a", 0.9), ("c", 0.1)], "model string, roc_auc double")
    assert evaluation.best_classifier(table).first()["model"] == "a"
    groups = spark.createDataFrame([(1, "x", 5), (1, "y", 5), (2, "z", 1)], "g int, name string, score int")
    assert {(r["g"], r["name"]) for r in best_row(groups, "score", "name", ["g"]).collect()} == {(1, "x"), (2, "z")}


# ---- splits ---------------------------------------------------------------------------------


@pytest.mark.parametrize("n, positives", [(1, 1), (7, 3), (1000, 333), (4001, 40)])
def test_stratified_split_is_exact_and_repeatable(spark, n, positives):
    rows = spark.range(n).select(F.col("id").alias("k"), (F.col("id") < positives).cast("int").alias("y"))
    first = splits.stratified_split(rows, "k", "y")
    counts = {r["y"]: (r["n"], r["t"]) for r in first.groupBy("y").agg(
        F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
    wanted = math.ceil(n * 0.25)
    assert sum(t for _, t in counts.values()) == wanted
    for size, chosen in counts.values():
        assert abs(chosen - wanted * size / n) < 1
    chosen = {r["k"] for r in first.filter("is_test").collect()}
    again = splits.stratified_split(rows.repartition(7), "k", "y")
    assert {r["k"] for r in again.filter("is_test").collect()} == chosen
    if n > 100:
        other = splits.stratified_split(rows, "k", "y", seed=1)
        assert {r["k"] for r in other.filter("is_test").collect()} != chosen


def test_random_split_share(spark):
    rows = spark.range(20000).withColumnRenamed("id", "k")
    share = splits.random_split(rows, "k").agg(F.avg(F.col("is_test").cast("int"))).first()[0]
    assert share == pytest.approx(0.25, abs=0.015)


# ---- matrix ---------------------------------------------------------------------------------


def people(spark):
    rows = [(1, "b", 1.0), (2, "a", 2.0), (3, None, 3.0), (4, "c. d", 4.0)]
    return spark.createDataFrame(rows, "k int, g string, v double")


def test_dummies_drop_the_first_level_and_take_unknowns(spark):
    table = people(spark)
    levels = matrix.category_levels(table, ("g",))
    assert levels == {"g": ["a", "b", "c. d"]}
    new = spark.createDataFrame([(9, "zzz", 0.0)], table.schema)
    columns = matrix.dummy_columns(levels)
    assert list(columns) == ["g_b", "g_c. d"]
    found = {r["k"]: (r["b"], r["c"]) for r in table.union(new).select(
        "k", columns["g_b"].alias("b"), columns["g_c. d"].alias("c")).collect()}
    assert found == {1: (1, 0), 2: (0, 0), 3: (0, 0), 4: (0, 1), 9: (0, 0)}


def test_thousands_of_levels_become_a_sparse_vector(spark):
    """Slots, names and scaled fits are those of the narrow encoding."""
    n = 2000
    table = spark.range(n + 2).select(
        F.col("id").alias("k"),
        F.when(F.col("id") < n, F.format_string("L%05d", "id")).alias("g"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("h"),
        (F.col("id") % 5).alias("v"),
    )
    design = matrix.Design.fit(table, ("v",), ("g", "h"))
    assert design.wide and len(design.names) == 1 + n - 1 + 1
    rows = {r["k"]: r["features"] for r in design.assemble(table, ["k"]).collect()}
    slot = {name: i for i, name in enumerate(design.names)}
    assert rows[0].toArray().nonzero()[0].tolist() == []
    assert rows[7].toArray().nonzero()[0].tolist() == [slot["v"], slot["g_L00007"], slot["h_b"]]
    assert rows[n].toArray().nonzero()[0].tolist() == [] and rows[7].size == len(design.names)
    scaler = design.fit_scaler(table)
    scaled = design.assemble(table, ["k"], scaler).filter("k = 7").first()["scaled"]
    share = 1 / (n + 2)
    assert scaled[slot["g_L00007"]] == pytest.approx(1 / math.sqrt(share * (1 - share)), rel=1e-9)


def test_scaling_and_vectors(spark):
    table = people(spark).withColumn("same", F.lit(7))
    design = matrix.Design.fit(table, ("v", "same"), ("g",))
    scaler = matrix.Scaler.fit(table, design.columns)
    assert scaler.mean["v"] == 2.5 and scaler.deviation["v"] == pytest.approx(math.sqrt(1.25))
    rows = {r["k"]: r for r in design.assemble(table, ["k"], scaler).collect()}
    assert design.names == ["v", "same", "g_b", "g_c. d"]
    assert list(rows[4]["features"].toArray()) == [4.0, 7.0, 0.0, 1.0]
    assert rows[1]["scaled"][1] == 0.0 and rows[1]["scaled"][0] == pytest.approx(-1.5 / math.sqrt(1.25))


def test_weights(spark):
    table = spark.createDataFrame([(i, int(i < 2)) for i in range(8)], "k int, y int")
    balanced = {r["y"]: r["balanced"] for r in matrix.balanced_weights(table, table, "y").collect()}
    assert balanced == {1: 8 / (2 * 2), 0: 8 / (2 * 6)}
    positive = {r["y"]: r["positive_weight"] for r in matrix.positive_weights(table, table, "y").collect()}
    assert positive == {1: 3.0, 0: 1.0}
    none = table.filter("y = 0")
    assert matrix.positive_weights(table, none, "y").filter("y = 1").first()["positive_weight"] == 6.0
    assert matrix.positive_weights(table, none, "y", guarded=False).filter("y = 1").first()["positive_weight"] is None
