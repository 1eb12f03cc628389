"""Report tables and the files a full run leaves behind."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from custoria.functions.columns import as_double
from custoria.operators import cohorts, experiment, overview
from custoria.plans import churn, spend
from custoria.sources.readers import Shop
from custoria.sources.reuse import settle
from custoria.sources.sinks import write_matrix, write_result


def overview_page(shop: Shop) -> DataFrame:
    """All numbers of the overview as (section, label, value).

    Orders are read twice: once for the totals by month and payment method, which are saved, and once for the item join.
    """

    def section(name: str, table: DataFrame, label: str, value: str) -> DataFrame:
        return table.select(F.lit(name).alias("section"), F.col(label).alias("label"), as_double(value).alias("value"))

    by_month = settle(overview.order_totals(shop.orders), "order-totals")
    totals = overview.kpis_of(shop.customers, by_month)
    totals = totals.select(*[as_double(c).alias(c) for c in totals.columns])
    parts = [
        section("kpi", totals.unpivot([], totals.columns, "label", "value"), "label", "value"),
        section(
            "revenue_by_category", overview.revenue_by_category(shop.orders, shop.order_items), "category", "revenue"
        ),
        section("revenue_by_month", overview.months_of(by_month), "month", "order_value"),
        section(
            "customers_by_channel", overview.mix(shop.customers, "acquisition_channel", "channel"), "channel", "count"
        ),
        section("orders_by_payment", overview.payments_of(by_month), "method", "count"),
    ]
    return reduce(DataFrame.unionByName, parts)


def experiment_summary(
    visits: DataFrame,
    effect: float = 0.15,
    alpha: float = experiment.ALPHA,
    power: float = experiment.POWER,
    baseline: float | None = None,
) -> DataFrame:
    """The summary lines of every experiment, designed for `baseline` or else for its control arm's rate."""
    return experiment.summary(experiment.with_design(experiment.readout(visits, alpha), effect, alpha, power, baseline))


def write_churn(shop: Shop, out: str, settings: churn.ChurnSettings = churn.ChurnSettings()) -> churn.ChurnRun:
    """Feature table, model comparison, ROC points, confusion matrix, report, attributions."""
    run = churn.run_churn(shop, settings)
    write_result(run.features, f"{out}/customer_features_full")
    write_result(run.comparison(), f"{out}/churn_model_comparison")
    write_result(run.report(), f"{out}/churn_classification_report")
    write_result(run.roc(), f"{out}/churn_roc_curve")
    write_result(run.best_confusion(), f"{out}/churn_confusion_matrix")
    write_result(run.forest_importance(), f"{out}/churn_forest_importance")
    write_result(run.top_attributions(), f"{out}/churn_attributions")
    return run


def write_spend(shop: Shop, out: str, settings: spend.SpendSettings = spend.SpendSettings()) -> spend.SpendRun:
    """Model comparison, actual against predicted, importances."""
    run = spend.run_spend(shop, settings)
    write_result(run.comparison(), f"{out}/clv_model_comparison")
    write_result(run.best_pairs(), f"{out}/clv_actual_vs_predicted")
    write_result(run.importance(), f"{out}/clv_feature_importance")
    return run


def write_cohorts(shop: Shop, out: str) -> None:
    """Retention and average cumulative revenue as matrices, from one pass over the orders."""
    cells = settle(cohorts.cohort_cells(shop.orders, shop.customers), "cohort-cells")
    names = ("cohort_month", "cohort_index")
    write_matrix(cohorts.retention(cells), f"{out}/cohort_retention_matrix", *names, "retention")
    write_matrix(
        cohorts.cumulative_revenue(cells), f"{out}/cohort_avg_clv_matrix", *names, "avg_cumulative_revenue"
    )


def write_overview(shop: Shop, out: str) -> None:
    write_result(overview.profile(shop), f"{out}/profile")
    write_result(overview_page(shop), f"{out}/overview")


def write_experiment(
    visits: DataFrame,
    out: str,
    effect: float = 0.15,
    alpha: float = experiment.ALPHA,
    power: float = experiment.POWER,
    baseline: float | None = None,
) -> None:
    """Readout, summary and power curve of every experiment."""
    results = settle(experiment.readout(visits, alpha), "readout")
    designed = experiment.with_design(results, effect, alpha, power, baseline)
    write_result(results, f"{out}/ab_test_readout")
    write_result(experiment.summary(designed), f"{out}/ab_test_summary")
    design = designed.select("experiment_id", "baseline_cr", "effect_size", "alpha", "power", "n_per_group")
    write_result(experiment.power_at(experiment.fixed_grid(design)), f"{out}/ab_test_power_curve")
