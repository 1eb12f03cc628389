"""Model runs: planted signals are found, runs repeat, attributions add up."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from custoria.__main__ import main
from custoria.operators import explain, learners, matrix
from custoria.plans import churn, reports, spend
from custoria.sources import sinks, star
from custoria.sources.reuse import settle
from tests.conftest import SMALL

FAST = churn.ChurnSettings(max_iter=50, trees=10, tree_depth=4, rounds=5, rate=0.2)
FAST_SPEND = spend.SpendSettings(rounds=10, rate=0.3)


@pytest.fixture(scope="module")
def planted(spark):
    """Customers who are likelier to churn the longer they have been silent, and who spend by rate."""
    rng = random.Random(11)
    rows = []
    for key in range(1200):
        silent, orders = rng.randint(0, 300), rng.randint(1, 20)
        churned = int(rng.random() < 1 / (1 + math.exp(-(silent - 150) / 30)))
        spent = 0.0 if churned else orders * 50 + rng.gauss(0, 20)
        rows.append(
            (key, orders, orders * 100.0, 100.0, silent, orders / 5, rng.random(), rng.randint(1, 8), rng.randint(18, 64))
            + (rng.choice("MF"), rng.choice(["Email", "Organic", "Paid Ads"]), rng.choice(["UPI", "Card"]))
            + (rng.choice(["Pune", "Delhi"]), churned, spent)
        )
    names = ["customer_id", *matrix.CHURN_NUMERIC, *matrix.CHURN_CATEGORIES, "churned", "future_90d_spend"]
    return spark.createDataFrame(rows, names).withColumn("churned", F.col("churned").cast("int"))


@pytest.fixture(scope="module")
def run(spark, planted):
    prepared = churn.prepare(planted, FAST)
    models = churn.train_models(prepared, FAST)
    return churn.ChurnRun(planted, prepared, models, settle(churn.score(models, prepared.test), "scores"))


def test_planted_churn_is_found(run):
    table = {r["model"]: r for r in run.comparison().collect()}
    assert set(table) == {churn.LOGISTIC, churn.FOREST, churn.BOOSTED}
    for row in table.values():
        assert row["roc_auc"] > 0.85 and 0 < row["f1"] <= 1
    assert run.scores.count() == 3 * 300
    assert run.best_confusion().agg(F.sum("n")).first()[0] == 300
    assert run.report().count() == 3 * 5


def test_silence_drives_the_models(run):
    assert run.forest_importance(3).first()["feature"] == "recency_days"
    assert run.top_attributions(3).first()["feature"] == "recency_days"
    assert run.top_attributions(3).count() == 3


def test_runs_repeat(run, planted):
    again = churn.score(churn.train_models(run.prepared, FAST), run.prepared.test)
    gap = again.join(run.scores.withColumnRenamed("prob", "before"), ["customer_id", "label", "model"])
    assert gap.agg(F.max(F.abs(F.col("prob") - F.col("before")))).first()[0] < 1e-9


def test_attributions_add_up_to_the_margin(run):
    model = run.models[churn.BOOSTED]
    scored = run.prepared.test.select("customer_id", model.margin_of().alias("margin"), model.score().alias("p"))
    margins = {r["customer_id"]: (r["margin"], r["p"]) for r in scored.collect()}
    rows = run.attributions().collect()
    assert len(rows) == len(margins) == 300
    for row in rows:
        margin, probability = margins[row["customer_id"]]
        assert sum(row["phi"]) + row["base"] == pytest.approx(margin, abs=1e-9)
        assert probability == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-9)


@pytest.mark.parametrize("tabled", [0, explain.TABLED])
def test_attributions_equal_the_sum_over_all_coalitions(monkeypatch, tabled):
    """With patterns tabulated per leaf, and without."""
    monkeypatch.setattr(explain, "TABLED", tabled)
    leaves = [
        explain.Leaf(2.0, (0, 1), (-np.inf, 0.5), (1.0, np.inf), (0.4, 0.3)),
        explain.Leaf(-1.0, (1, 2), (-np.inf, -np.inf), (0.5, 2.0), (0.7, 0.6)),
        explain.Leaf(0.5, (0, 1, 2), (1.0, 0.0, 2.0), (np.inf, 1.0, 5.0), (0.6, 0.5, 0.4)),
        explain.Leaf(3.0, (), (), (), ()),
    ]

    def value(x, known):
        total = 0.0
        for leaf in leaves:
            part = leaf.value
            for f, low, high, share in zip(leaf.features, leaf.low, leaf.high, leaf.share):
                part *= float(low < x[f] <= high) if f in known else share
            total += part
        return total

    rng = random.Random(2)
    for _ in range(20):
        x = [rng.uniform(-1, 6) for _ in range(3)]
        found = explain.attribute(np.array([x]), leaves)[0]
        for i in range(3):
            others, wanted = [f for f in range(3) if f != i], 0.0
            for size in range(3):
                for known in itertools.combinations(others, size):
                    weight = math.factorial(size) * math.factorial(2 - size) / math.factorial(3)
                    wanted += weight * (value(x, {*known, i}) - value(x, set(known)))
            assert found[i] == pytest.approx(wanted, abs=1e-12)
    assert explain.base_value(leaves) == pytest.approx(value([0, 0, 0], set()))


def test_planted_spend_is_found(spark, planted):
    prepared = spend.prepare(planted, FAST_SPEND)
    models = spend.train_models(prepared, FAST_SPEND)
    done = spend.SpendRun(prepared, models, spend.score(models, prepared.test, FAST_SPEND.label))
    table = {r["model"]: r for r in done.comparison().collect()}
    assert table[spend.BOOSTED]["r2"] > table[spend.LINEAR]["r2"] > 0.2
    assert done.best_pairs().select("model").distinct().first()["model"] == spend.BOOSTED
    assert {r["feature"] for r in done.importance(8).collect()} >= {"recency_days"}


def test_short_variant_uses_fewer_columns(spark, planted):
    settings = churn.ChurnSettings.interactive(60, trees=3, rounds=2)
    prepared = churn.prepare(planted, settings)
    assert settings.window_days == 60 and settings.rate == 0.08
    assert prepared.design.names[-3:] == ["gender_M", "acquisition_channel_Organic", "acquisition_channel_Paid Ads"]


def test_command_line_leaves_the_result_files(spark, tmp_path):
    shop = star.shop(spark, SMALL)
    data, out = str(tmp_path / "data"), str(tmp_path / "out")
    numbered = shop.order_items.withColumn("order_item_id", F.monotonically_increasing_id())
    for name, frame in (("customers", shop.customers), ("orders", shop.orders), ("order_items", numbered)):
        sinks.write_result(frame, f"{data}/{name}.csv")
    sinks.write_result(star.visits(spark, SMALL, "all"), f"{data}/visits.csv")
    main(["overview", "--data", data, "--out", out])
    main(["cohorts", "--data", data, "--out", out])
    main(["churn", "--data", data, "--out", out, "--trees", "3", "--rounds", "2"])
    main(["spend", "--data", data, "--out", out, "--rounds", "2", "--as-of", "2001-08-01"])
    main(["experiment", "--visits", f"{data}/visits.csv", "--out", out])

    def read(name):
        return spark.read.option("header", True).csv(f"{out}/{name}")

    assert read("churn_model_comparison").columns == ["model", "roc_auc", "precision", "recall", "f1"]
    assert len(read("customer_features_full").columns) == 19
    assert read("clv_model_comparison").count() == 2
    assert read("ab_test_summary").filter("experiment_id = 'all'").count() == 8
    assert read("cohort_retention_matrix").columns[:2] == ["cohort_month", "0"]
    assert read("profile").count() == 3 and read("ab_test_power_curve").count() == 78
    assert {f.name for f in tmp_path.joinpath("out").iterdir()} >= {"churn_roc_curve", "churn_attributions", "overview"}
    assert reports.overview_page(shop).count() == read("overview").count()


def test_logistic_regression_converges(spark, planted):
    """The solver settles by itself, and the penalised gradient is zero there."""
    prepared = churn.prepare(planted, FAST)
    total = prepared.train.agg(F.sum("balanced")).first()[0]
    model = learners.logistic_regression(prepared.train, churn.LABEL, "balanced", total)
    assert model.summary.totalIterations < 1000
    error = F.col("balanced") * (vector_to_array("probability")[1] - F.col(churn.LABEL))
    x = vector_to_array("scaled")
    weights = model.coefficients.toArray()
    sums = model.transform(prepared.train).agg(*[F.sum(error * x[i]) for i in range(len(weights))]).first()
    assert max(abs(s + w) / total for s, w in zip(sums, weights)) < 1e-4
