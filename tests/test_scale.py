"""Plans and results that must hold when one key has a third of all rows."""

import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from checks import QUERIES
from custoria.operators import cohorts, evaluation, experiment, features, labels, ordered, overview
from custoria.operators.bounds import sized
from custoria.operators.horizon import horizon, last_date, observed
from custoria.operators.reshape import best_row
from custoria.plans.reports import overview_page
from custoria.sources import star
from custoria.sources.readers import Shop
from tests.conftest import SMALL

MODELS = ("L0", "E10", "E11", "Q08", "Q09")
NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
EAGER_SPLIT = {
    **NO_BROADCAST,
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000",
}


@contextmanager
def settings(spark, values):
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def final_plan(frame):
    frame.collect()
    return plan(frame).split("Initial Plan")[0]


# Orders 0..59999: every third one is placed by customer 1, the rest by 2000 customers.
N, CUSTOMERS = 60_000, 2_000


@pytest.fixture(scope="module")
def skewed(spark):
    key = F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % CUSTOMERS)
    placed = spark.range(0, N, 1, 8).select(
        F.col("id").alias("order_id"),
        key.cast("bigint").alias("customer_id"),
        F.date_add(F.lit("2023-01-01").cast("date"), (F.col("id") * 7 % 700).cast("int")).alias("order_date"),
        (F.col("id") % 97 + 0.25).alias("order_value"),
        (F.col("id") % 2).cast("int").alias("discount_applied"),
        F.element_at(F.array(F.lit("Card"), F.lit("UPI"), F.lit("COD")), (F.col("id") % 3 + 1).cast("int")).alias(
            "payment_method"
        ),
    )
    people = spark.range(0, CUSTOMERS).select(
        F.col("id").alias("customer_id"),
        F.date_add(F.lit("2022-06-01").cast("date"), (F.col("id") % 200).cast("int")).alias("signup_date"),
    )
    # A third of all items belongs to order 5.
    lines = spark.range(0, N, 1, 8).select(
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).cast("bigint").alias("order_id"),
        F.concat(F.lit("c"), F.col("id") % 8).alias("category"),
        F.lit(2).alias("quantity"),
        F.lit(1.5).alias("item_price"),
    )
    return people, placed, lines


def test_hot_order_is_split_in_the_item_join(spark, skewed):
    _, placed, lines = skewed
    with settings(spark, EAGER_SPLIT):
        for frame in (
            features.category_diversity(placed, lines, horizon(placed, as_of="2024-12-01")),
            overview.revenue_by_category(placed, lines),
        ):
            assert "skew=true" in final_plan(frame)
        total = overview.revenue_by_category(placed, lines).agg(F.sum("revenue")).first()[0]
    assert total == N * 3.0


def test_hot_customer_does_not_reach_one_task(spark, skewed):
    """Orders are combined before they are shuffled: the hot customer leaves a few rows per task."""
    people, placed, _ = skewed
    span = horizon(placed, as_of="2024-12-01")
    with settings(spark, NO_BROADCAST):
        for frame in (
            features.order_history(placed, span, payment=True),
            features.order_history(placed, span),
            features.preferred_payment(placed, span),
            labels.churn_sweep(people, placed),
            labels.future_buyers(placed, span),
            cohorts.cohort_cells(placed, people),
        ):
            text = plan(frame)
            below = [line for line in text.split("\n") if "Exchange" in line or "Aggregate" in line]
            # Read upwards: the first thing done to the scanned orders is a partial aggregate.
            scans = [i for i, line in enumerate(text.split("\n")) if f"Range (0, {N}" in line]
            for scan in scans:
                above = [line for line in text.split("\n")[:scan] if "Exchange" in line or "Aggregate" in line]
                assert "Aggregate" in above[-1], text
            assert below
        row = features.order_history(placed, span, payment=True).filter("customer_id = 1").first()
    assert row["total_orders"] > N // 4 and row["preferred_payment"] == "Card"


def test_top_row_per_group_is_limited_before_the_shuffle(spark, skewed):
    frame = best_row(skewed[1].select("customer_id", "order_id", "order_value"), "order_value", "order_id", ["customer_id"])
    assert re.search(r"WindowGroupLimit.*Partial", plan(frame))
    assert frame.count() == CUSTOMERS


def test_warehouse_orders_split_a_hot_customer(spark, tmp_path):
    """The semi join of the order view feeds an aggregate on its own key, and is split all the same."""
    rows = spark.range(0, 40_000, 1, 8)
    rows.select(
        F.col("id").alias("o_orderkey"),
        F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 500).cast("bigint").alias("o_custkey"),
        F.lit("P").alias("o_orderstatus"),
        F.rand(1).alias("o_totalprice"),
        F.lit("2002-01-01 00:00:00").cast("timestamp_ntz").alias("o_orderdate"),
        F.lit("1-URGENT").alias("o_orderpriority"),
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(500).select(
        F.col("id").alias("c_custkey"), F.lit(0).alias("c_nationkey"), F.lit("X").alias("c_mktsegment")
    ).write.parquet(f"{tmp_path}/customer.parquet")
    with settings(spark, EAGER_SPLIT):
        frame = star.orders(spark, str(tmp_path)).groupBy("customer_id").agg(
            F.count("*").alias("n"), F.max("order_value"), F.max("order_id")
        )
        assert "skew=true" in final_plan(frame)
        assert frame.agg(F.sum("n")).first()[0] == 40_000


def test_results_do_not_depend_on_the_join_strategy(spark, skewed):
    people, placed, lines = skewed
    span = horizon(placed)
    people = people.withColumns(
        {"city": F.lit("x"), "age": F.lit(20), "gender": F.lit("F"), "acquisition_channel": F.lit("y")}
    )

    def everything():
        return (
            sorted(map(tuple, features.churn_features(people, placed, lines, span).collect())),
            sorted(map(tuple, cohorts.cohort_cells(placed, people).collect())),
        )

    first = everything()
    with settings(spark, EAGER_SPLIT):
        assert everything() == first
    assert len(first[0]) == CUSTOMERS


def test_no_query_pairs_everything_with_everything(spark):
    with settings(spark, NO_BROADCAST):
        for name, run in QUERIES.items():
            if not name.startswith(MODELS):
                text = plan(run(spark, SMALL))
                assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = f"{tmp_path}/orders"
    star.orders(spark, SMALL).write.parquet(path)
    placed = spark.read.parquet(path)
    span = horizon(placed, as_of="2001-08-01")
    text = features.rfm(placed, span)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*LessThanOrEqual\(order_date,2001-05-03\)", text)
    text = plan(cohorts.cohort_cells(placed, star.customers(spark, SMALL)))
    assert "ReadSchema: struct<customer_id:bigint,order_date:date,order_value:double>" in text
    text = plan(observed(placed, span).select("order_id"))
    assert "ReadSchema: struct<order_id:bigint,order_date:date>" in text


def test_orders_are_scanned_once_for_both_slices(spark, tmp_path):
    path = f"{tmp_path}/orders"
    star.orders(spark, SMALL).write.parquet(path)
    placed = spark.read.parquet(path)
    history = features.order_history(placed, horizon(placed, as_of="2001-08-01"))
    assert plan(history).count("Scan parquet") == 1 and plan(history).count("Exchange") == 1


def test_overview_scans_orders_once_next_to_the_item_join(spark, tmp_path):
    """The totals by month and payment method are saved from one scan; the other is the join with items."""
    shop = star.shop(spark, SMALL)
    saved = [f"{tmp_path}/{name}" for name in ("customers", "orders", "order_items")]
    for frame, path in zip((shop.customers, shop.orders, shop.order_items), saved):
        frame.write.parquet(path)
    text = plan(overview_page(Shop(*map(spark.read.parquet, saved))))
    scans = [line for line in text.split("\n") if "FileScan parquet" in line and saved[1].rsplit("/", 1)[-1] + "]" in line]
    assert all("order_value:double" not in line and "order_date:date" not in line for line in text.split("\n"))
    assert len(scans) <= 1


def test_the_resolved_last_date_reaches_the_scan(spark, tmp_path):
    path = f"{tmp_path}/orders"
    star.orders(spark, SMALL).write.parquet(path)
    placed = spark.read.parquet(path)
    text = plan(features.rfm(placed, horizon(placed, as_of=last_date(placed))))
    assert re.search(r"PushedFilters: \[[^\]]*LessThanOrEqual\(order_date,", text)


def test_visits_are_aggregated_before_the_only_large_shuffle(spark):
    text = plan(experiment.readout(star.visits(spark, SMALL)))
    scan = text.split("\n").index(next(line for line in text.split("\n") if "Scan parquet" in line))
    above = [line for line in text.split("\n")[:scan] if "Exchange" in line or "Aggregate" in line]
    assert "Aggregate" in above[-1] and "partial" in above[-1]


def test_small_tables_are_broadcast_by_their_true_size_and_large_ones_are_not(spark):
    facts = spark.range(0, 100_000, 1, 8).withColumn("k", F.col("id") % 1500)
    small = sized(facts.groupBy("k").agg(F.count("*").alias("n")))
    assert small.count() == 1500
    with settings(spark, {"spark.sql.adaptive.enabled": "false"}):
        assert "BroadcastHashJoin" in plan(facts.join(small, "k"))
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "1000"}):
        joined = facts.join(small, "k")
        assert "SortMergeJoin" in plan(joined) and joined.count() == 100_000


def test_more_than_a_thousand_models_are_evaluated(spark):
    rows = spark.range(1500 * 8).select(
        (F.col("id") % 1500).cast("string").alias("model"), (F.col("id") % 2).cast("int").alias("label"),
        ((F.col("id") * 7919) % 1009 / 1009.0).alias("prob"),
    )
    found = evaluation.compare_classifiers(rows)
    assert found.count() == 1500


def test_rows_of_a_null_group_are_kept(spark):
    frame = spark.createDataFrame([(None, 1.0, 2), (None, 3.0, 5), ("a", 1.0, 1), ("a", 0.5, 0)], "g string, v double, x bigint")
    found = {(r["g"], r["v"]): r["s"] for r in ordered.running_totals(frame, "g", "v", {"x": "s"}).collect()}
    assert found == {(None, 3.0): 5, (None, 1.0): 7, ("a", 1.0): 1, ("a", 0.5): 1}
