"""Published constants, degenerate experiments and the three recommendations."""

import math
from statistics import NormalDist

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from custoria.functions.probability import add_normal_cdf, add_normal_quantile, t_two_sided, z_value
from custoria.operators import experiment
from custoria.plans import reports
from tests import frames


def design(spark, *rows):
    return spark.createDataFrame(list(rows), "baseline_cr double, mde_relative double, alpha double, power double")


def test_published_sample_size(spark):
    row = experiment.plan_experiments(design(spark, (0.12, 0.15, 0.05, 0.80))).first()
    assert row["n_per_group"] == 5438 and row["total_n"] == 10876
    assert row["target_cr"] == pytest.approx(0.138)


def test_power_at_the_required_size_reaches_the_target(spark):
    menu = design(spark, *[(b, 0.15, a, p) for b in (0.02, 0.3) for a in (0.01, 0.05, 0.1) for p in (0.7, 0.8, 0.9)])
    planned = experiment.plan_experiments(menu).withColumn("n", F.col("n_per_group"))
    for row in experiment.power_at(planned).collect():
        assert row["power_at_n"] >= row["power"] - 1e-12
    one_less = experiment.power_at(planned.withColumn("n", F.col("n") - 1))
    for row in one_less.collect():
        assert row["power_at_n"] < row["power"]


def test_no_effect_needs_no_finite_sample(spark):
    assert experiment.plan_experiments(design(spark, (0.12, 0.0, 0.05, 0.8))).first()["n_per_group"] is None


def test_grids(spark):
    planned = experiment.plan_experiments(design(spark, (0.12, 0.15, 0.05, 0.80)))
    fixed = [r["n"] for r in experiment.fixed_grid(planned).collect()]
    assert fixed == list(range(500, 20000, 250))
    relative = [r["n"] for r in experiment.relative_grid(planned).collect()]
    assert relative == list(range(max(200, 5438 // 10), 5438 * 2, 5438 // 40))
    tiny = planned.withColumn("n_per_group", F.lit(80).cast("bigint"))
    assert experiment.relative_grid(tiny).count() == 0


def test_published_z_test(spark):
    table = frames.visits(spark, a=((5438, 635, [1800, 1900]), (5438, 718, [1650, 1700])))
    row = experiment.readout(table).first()
    assert row["z_stat"] == pytest.approx(2.41144, abs=5e-6)
    assert round(row["p_conversion"], 5) == 0.00794
    assert round(row["control_conversion_rate"], 4) == 0.1168
    assert row["treatment_ci_low"] < row["treatment_conversion_rate"] < row["treatment_ci_high"]


def test_three_recommendations(spark):
    table = frames.visits(
        spark,
        win=((400, 40, [100, 110]), (400, 100, [100, 110])),
        loss=((400, 40, [100, 110]), (400, 100, [10, 11])),
        open=((400, 40, [100, 110]), (400, 41, [100, 110])),
    )
    found = {r["experiment_id"]: r for r in experiment.readout(table).collect()}
    assert {k: r["advice_detailed"] for k, r in found.items()} == {
        "win": "Roll out",
        "loss": "Do not roll out as-is",
        "open": "Inconclusive",
    }
    assert found["open"]["advice"] == found["loss"]["advice"] == "Do not roll out as-is"
    assert found["loss"]["lift_sign"] == "negative" and found["win"]["conversion_significant"] == "YES"
    for row in found.values():
        assert row["significant"] == (row["conversion_significant"] == "YES")


def test_degenerate_experiments_give_nulls(spark):
    table = frames.visits(
        spark, none=((50, 0, [1]), (50, 0, [1])), base=((50, 0, [1]), (50, 5, [1])), alone=((50, 5, [1]), (0, 0, [1]))
    )
    found = {r["experiment_id"]: r for r in experiment.readout(table).collect()}
    assert found["none"]["z_stat"] is None and found["none"]["relative_lift"] is None
    assert found["none"]["advice_detailed"] == "Inconclusive"
    assert found["base"]["relative_lift"] is None and found["base"]["z_stat"] > 0
    assert found["alone"]["z_stat"] is None and found["alone"]["p_aov"] is None


def test_summary_lines(spark):
    table = frames.visits(spark, a=((5438, 635, [1800, 1900]), (5438, 718, [1650, 1700])))
    lines = {r["metric"]: r["value"] for r in reports.experiment_summary(table).collect()}
    assert len(lines) == 8
    assert lines["Observed control CR"] == "11.68%" and lines["Observed treatment CR"] == "13.20%"
    assert lines["Conversion z-test p-value"] == "0.00794"
    assert lines["Baseline conversion rate"] == "11.68%"
    assert lines["Revenue-per-visitor lift"].startswith("Rs.")


def test_published_summary_from_the_planned_baseline(spark):
    table = frames.visits(spark, a=((5438, 635, [1800, 1900]), (5438, 718, [1650, 1700])))
    lines = {r["metric"]: r["value"] for r in reports.experiment_summary(table, baseline=0.12).collect()}
    assert lines["Baseline conversion rate"] == "12.00%"
    assert lines["Target conversion rate (design)"] == "13.80%"
    assert lines["Required sample size per group"] == "5,438"
    assert lines["Observed control CR"] == "11.68%" and lines["Observed treatment CR"] == "13.20%"
    assert lines["Conversion z-test p-value"] == "0.00794"


def test_normal_functions(spark):
    points = [-30.0, -10.0, -3.0, -1e-9, 0.0, 0.4, 1.959963984540054, 6.0, 12.0, None]
    frame = spark.createDataFrame([(z,) for z in points], "z double")
    for row in add_normal_cdf(frame, F.col("z"), "p").collect():
        if row["z"] is None:
            assert row["p"] is None
        else:
            assert row["p"] == pytest.approx(0.5 * math.erfc(-row["z"] / math.sqrt(2)), rel=2e-13)
    levels = [1e-300, 1e-20, 0.001, 0.07, 0.2, 0.5, 0.925, 0.93, 1 - 1e-12, 0.0, 1.0, -1.0, None]
    frame = spark.createDataFrame([(p,) for p in levels], "p double")
    for row in add_normal_quantile(frame, F.col("p"), "z").collect():
        if row["p"] is None or not 0 < row["p"] < 1:
            assert row["z"] is None
        else:
            assert row["z"] == pytest.approx(NormalDist().inv_cdf(row["p"]), rel=1e-14, abs=1e-15)


def test_t_probabilities():
    # Student's t has closed forms for one and two degrees of freedom.
    for t in (0.1, 1.0, 3.0, 40.0):
        one, two = t_two_sided([t, t], [1, 2])
        assert one == pytest.approx(1 - 2 * math.atan(t) / math.pi, abs=1e-13)
        assert two == pytest.approx(1 - t / math.sqrt(2 + t * t), abs=1e-13)
    for t in (0.0, 0.5, 2.0, 4.0):
        assert t_two_sided([t], [1e12])[0] == pytest.approx(math.erfc(t / math.sqrt(2)), rel=1e-9)
        assert t_two_sided([-t], [30])[0] == t_two_sided([t], [30])[0]
        below, above = t_two_sided([t, t], [99_999, 100_001])
        assert below == pytest.approx(above, rel=2e-8)
    assert math.isnan(t_two_sided([1.0], [0])[0])


def test_a_design_outside_its_domain_is_null_and_spoils_no_other(spark):
    rows = [(0.12, 0.15, 0.05, p) for p in (0.8, 0.03, 1.0)] + [(0.12, 0.15, 0.0, 0.8), (0.12, 1e-11, 0.05, 0.8)]
    found = experiment.plan_experiments(design(spark, *rows)).collect()
    sizes = {(r["mde_relative"], r["alpha"], r["power"]): r["n_per_group"] for r in found}
    assert sizes.pop((0.15, 0.05, 0.8)) == 5438 and set(sizes.values()) == {None}


def test_order_values_are_not_rounded(spark):
    row = experiment.readout(frames.visits(spark, a=((50, 2, [0.004, 0.004]), (50, 2, [1234.5678, 1234.5678])))).first()
    assert row["control_aov"] == pytest.approx(0.004) and row["treatment_aov"] == pytest.approx(1234.5678)


def test_no_python_in_the_design(spark):
    menu = design(spark, (0.12, 0.15, 0.05, 0.80)).repartition(2)
    text = experiment.power_at(experiment.fixed_grid(experiment.plan_experiments(menu)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text


def test_other_variants_and_null_keys(spark):
    rows = [("a", v, c, 10.0 if c else None) for v in ("control", "treatment", "third") for c in (0, 1, 1)]
    rows += [(None, "control", 1, 5.0)]
    visits = spark.createDataFrame(rows, "experiment_id string, variant string, converted int, order_value double")
    arms = experiment.arms(visits)
    assert arms.filter("experiment_id is null").count() == 0
    with pytest.raises(PySparkException, match="no control or treatment"):
        experiment.side_by_side(arms).collect()
    pairs = experiment.side_by_side(experiment.against_control(arms)).collect()
    assert sorted(r["experiment_id"] for r in pairs) == ["a/third", "a/treatment"]
    assert all(r["control_visitors"] == r["treatment_visitors"] == 3 for r in pairs)


def test_impossible_targets_give_nulls(spark):
    row = experiment.plan_experiments(design(spark, (0.8, 0.5, 0.05, 0.8))).first()
    assert row["target_cr"] == pytest.approx(1.2) and row["effect_size"] is None and row["n_per_group"] is None
    planned = experiment.plan_experiments(design(spark, (0.8, 0.5, 0.05, 0.8)))
    assert experiment.power_at(experiment.fixed_grid(planned)).filter("power_at_n is not null").count() == 0


def test_an_arm_without_buyers_earns_nothing(spark):
    row = experiment.readout(frames.visits(spark, a=((50, 0, [1]), (50, 10, [20])))).first()
    assert (row["revenue_control"], row["revenue_treatment"], row["lift_sign"]) == (0.0, 4.0, "positive")
    assert row["control_aov"] is None and row["t_stat"] is None
