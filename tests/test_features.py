"""Edge cases of features, labels and cohorts."""

import pytest
from pyspark.sql import functions as F

from custoria.operators import cohorts, features, labels, overview, reshape
from custoria.operators.horizon import eligible, horizon, observed, outcome
from tests import frames

# Last order 2024-06-29, so the 90 day cutoff is 2024-03-31.
LAST = (99, 9, "2024-06-29", 10)
CUTOFF = "2024-03-31"


def table_of(spark, people, placed, bought=((99, "Toys", 1, 5),), **options):
    shop = frames.customers(spark, *people), frames.orders(spark, *placed)
    rows = features.churn_features(*shop, frames.items(spark, *bought), horizon(shop[1]), **options).collect()
    return {row["customer_id"]: row for row in rows}


def test_payment_tie_takes_the_lowest_name(spark):
    placed = [(1, 1, "2024-01-01", 10, "UPI"), (2, 1, "2024-01-02", 10, "Card"), LAST]
    assert table_of(spark, [(1, "2024-01-01")], placed)[1]["preferred_payment"] == "Card"
    shop = frames.orders(spark, *placed)
    assert features.preferred_payment(shop, horizon(shop)).first()["preferred_payment"] == "Card"


def test_payment_ignores_nulls_and_later_orders(spark):
    placed = [
        (1, 1, "2024-01-01", 10, None),
        (2, 1, "2024-01-02", 10, None),
        (3, 1, "2024-01-03", 10, "UPI"),
        (4, 1, "2024-05-01", 10, "Card"),
        (5, 1, "2024-05-02", 10, "Card"),
        LAST,
    ]
    row = table_of(spark, [(1, "2024-01-01")], placed)[1]
    assert (row["preferred_payment"], row["total_orders"]) == ("UPI", 3)


def test_customer_without_history(spark):
    row = table_of(spark, [(1, "2024-03-01")], [LAST])[1]
    assert row["total_orders"] == row["category_diversity"] == 0
    assert row["total_spend"] == row["avg_order_value"] == row["discount_rate"] == row["order_frequency"] == 0.0
    assert row["recency_days"] == 30 and row["preferred_payment"] == "None" and row["churned"] == 1
    assert row["tenure_days"] is None and row["last_order_date"] is None and row["discount_orders"] is None


def test_customer_with_later_orders_only(spark):
    row = table_of(spark, [(1, "2024-03-01")], [(1, 1, "2024-05-01", 50), LAST])[1]
    assert row["total_orders"] == 0 and row["preferred_payment"] == "None" and row["churned"] == 0


def test_signup_after_cutoff_is_absent(spark):
    assert set(table_of(spark, [(1, "2024-03-31"), (2, "2024-04-01")], [LAST])) == {1}


def test_cutoff_day_is_history(spark):
    placed = frames.orders(spark, (1, 1, CUTOFF, 10), (2, 1, "2024-04-01", 10), LAST)
    span = horizon(placed)
    assert {r["order_id"] for r in observed(placed, span).collect()} == {1}
    assert {r["order_id"] for r in outcome(placed, span).collect()} == {2, 99}


def test_null_customer_is_dropped(spark):
    placed = [(1, None, "2024-01-01", 10), (2, 1, "2024-01-01", 10), LAST]
    assert set(table_of(spark, [(1, "2024-01-01"), (9, "2024-01-01")], placed)) == {1, 9}
    shop = frames.orders(spark, *placed)
    assert features.rfm(shop, horizon(shop)).filter("customer_id is null").count() == 0
    assert labels.future_buyers(shop, horizon(shop)).count() == 1


def test_order_without_items_counts_nowhere_in_categories(spark):
    placed = frames.orders(spark, (1, 1, "2024-01-01", 10), (2, 2, "2024-01-01", 10), LAST)
    bought = frames.items(spark, (1, "Toys", 2, 5), (1, "Books", 1, 3), (1, "Toys", 1, 5), (77, "Toys", 1, 1000))
    found = features.category_diversity(placed, bought, horizon(placed)).collect()
    assert [(r[0], r[1]) for r in found] == [(1, 2)]
    revenue = overview.revenue_by_category(placed, bought).collect()
    assert [(r["category"], r["revenue"]) for r in revenue] == [("Toys", 15.0), ("Books", 3.0)]


def test_later_orders_change_labels_only(spark):
    """The leak test: an order after the cutoff must not move any feature."""
    people = [(1, "2024-01-01"), (2, "2024-01-01")]
    base = [(1, 1, "2024-01-01", 10, "UPI", 1), (2, 1, "2024-02-01", 30), (3, 2, "2024-03-01", 20), LAST]
    before = table_of(spark, people, base, [(1, "Toys", 1, 1)])
    after = table_of(
        spark, people, [*base, (4, 1, "2024-05-01", 999, "Cash", 1)], [(1, "Toys", 1, 1), (4, "Books", 1, 1)]
    )
    for key in (1, 2):
        strip = lambda row: {k: v for k, v in row.asDict().items() if k != "churned"}
        assert strip(before[key]) == strip(after[key])
    assert (before[1]["churned"], after[1]["churned"]) == (1, 0)
    assert before[2]["churned"] == after[2]["churned"] == 1


def test_explicit_date_equals_the_scanned_one(spark):
    people = frames.customers(spark, (1, "2024-01-01"))
    placed = frames.orders(spark, (1, 1, "2024-02-01", 10), LAST)
    bought = frames.items(spark, (1, "Toys", 1, 1))
    scanned = features.churn_features(people, placed, bought, horizon(placed)).collect()
    given = features.churn_features(people, placed, bought, horizon(placed, as_of="2024-06-29")).collect()
    assert scanned == given


def test_sweep_equals_the_single_windows(spark):
    people = frames.customers(spark, *[(i, f"2024-0{1 + i % 5}-01") for i in range(1, 9)], (50, None))
    placed = frames.orders(spark, *[(i, i, f"2024-0{1 + i % 6}-15", 10) for i in range(1, 7)], LAST)
    swept = {r["window_days"]: r for r in labels.churn_sweep(people, placed).collect()}
    assert sorted(swept) == list(range(30, 181, 15))
    for days, row in swept.items():
        single = labels.class_summary(labels.churn_labels(people, placed, horizon(placed, days))).first()
        assert (row["eligible"], row["churned"]) == (single["customers"], single["positives"])
        assert row["churn_rate"] == single["positive_rate"]


def test_members_and_others_make_up_the_eligible(spark):
    people = frames.customers(spark, (1, "2024-01-01"), (2, "2024-01-01"), (9, "2024-01-01"))
    placed = frames.orders(spark, (1, 1, "2024-05-01", 10), LAST)
    span = horizon(placed)
    back, gone = labels.returning(people, placed, span), labels.lost(people, placed, span)
    assert back.count() + gone.count() == eligible(people, span).count()
    assert {r["customer_id"] for r in gone.collect()} == {2}


def test_empty_classes_give_null_rates(spark):
    empty = spark.createDataFrame([], "customer_id bigint, churned int")
    row = labels.class_summary(empty).first()
    assert row["customers"] == 0 and row["positive_rate"] is None and row["balance"] is None
    only = labels.class_summary(spark.createDataFrame([(1, 0)], "customer_id bigint, churned int")).first()
    assert only["balance"] is None and only["balance_guarded"] == 1.0


# ---- cohorts --------------------------------------------------------------------------------


def test_silent_month_and_cohort_of_purchasers(spark):
    people = frames.customers(spark, (1, "2024-01-05"), (2, "2024-01-20"), (3, "2024-01-25"))
    placed = frames.orders(spark, (1, 1, "2024-01-06", 10), (2, 2, "2024-03-01", 5), (3, None, "2024-03-01", 5))
    cells = cohorts.cohort_cells(placed, people)
    found = {r["cohort_index"]: r for r in cohorts.cumulative_revenue(cells).collect()}
    assert {i: (r["cohort_size"], r["cumulative_revenue"]) for i, r in found.items()} == {0: (2, 10.0), 2: (2, 15.0)}
    wide = reshape.to_matrix(
        cohorts.cumulative_revenue(cells), "cohort_month", "cohort_index", "cumulative_revenue", [0, 1, 2]
    ).first()
    assert (wide["0"], wide["1"], wide["2"]) == (10.0, None, 15.0)


def test_retention_properties(spark):
    people = frames.customers(spark, *[(i, f"2024-0{1 + i % 4}-10") for i in range(40)])
    placed = frames.orders(
        spark, *[(i, i % 40, f"2024-{4 + i % 8:02d}-{1 + i % 28:02d}", 1 + i % 7) for i in range(300)]
    )
    cells = cohorts.cohort_cells(placed, people)
    for row in cohorts.retention(cells).collect():
        assert 0 < row["retention"] <= 1
    last = {}
    for row in cohorts.cumulative_revenue(cells).orderBy("cohort_month", "cohort_index").collect():
        assert row["avg_cumulative_revenue"] >= last.get(row["cohort_month"], 0)
        last[row["cohort_month"]] = row["avg_cumulative_revenue"]
    total = placed.agg(F.sum("order_value")).first()[0]
    assert cells.agg(F.sum("revenue")).first()[0] == pytest.approx(total)


def test_first_labels_are_positional(spark):
    cells = spark.createDataFrame([(m, i, 1) for m in (10, 30, 20) for i in (-1, 0, 5)], "m int, i int, v int")
    kept = reshape.first_labels(cells, m=2, i=2).collect()
    assert {(r["m"], r["i"]) for r in kept} == {(10, -1), (10, 0), (20, -1), (20, 0)}
    # Column 0 is found in the third row only, and still is the first column of the matrix.
    cells = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 0)], "m int, i int")
    kept = reshape.first_labels(cells, m=2, i=2).collect()
    assert {(r["m"], r["i"]) for r in kept} == {(1, 1), (2, 1)}


def test_matrix_and_long_form_are_inverse(spark):
    cells = spark.createDataFrame([("a", 0, 1.0), ("a", 2, 2.0), ("b", 0, 3.0)], "row string, col int, v double")
    matrix = reshape.to_matrix(cells, "row", "col", "v")
    assert matrix.columns == ["row", "0", "2"]
    back = reshape.to_long(matrix, "row", "col", "v").filter("v is not null")
    assert {tuple(r) for r in back.collect()} == {("a", "0", 1.0), ("a", "2", 2.0), ("b", "0", 3.0)}


def test_money_sums_are_exact_beyond_one_long(spark):
    from decimal import Decimal

    from custoria.functions.columns import cents_sum, money_sum

    big = 9_000_000_000_000_000_000
    frame = spark.createDataFrame([(1, big), (1, big), (1, 7), (2, -5), (2, 3), (3, None)], "k int, c bigint")
    found = {r["k"]: r["s"] for r in frame.groupBy("k").agg(cents_sum("c").alias("s")).collect()}
    assert found == {1: Decimal(2 * big + 7) / 100, 2: Decimal("-0.02"), 3: None}
    values = [0.1, 0.2, 1e9 + 0.07, 1013.7, 2.675, -3.01]
    row = spark.createDataFrame([(v,) for v in values], "v double").agg(money_sum("v").alias("s")).first()
    assert row["s"] == sum(round(Decimal(repr(v)) * 100) for v in values) / Decimal(100)


def test_matrix_columns_follow_from_the_data(spark):
    cells = spark.createDataFrame([("a", 0, 1.0), ("a", 95, 2.0), ("b", 3, 4.0)], "row string, col int, v double")
    wide = reshape.to_matrix(cells, "row", "col", "v")
    assert wide.columns == ["row", "0", "3", "95"]
    assert {r["row"]: r["95"] for r in wide.collect()} == {"a": 2.0, "b": None}
    with pytest.raises(Exception, match="no column is named"):
        reshape.to_matrix(cells, "row", "col", "v", [0, 3]).collect()
