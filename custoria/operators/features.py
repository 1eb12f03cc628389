"""Recency, frequency and monetary features per customer, free of the outcome window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from custoria.functions.columns import add_parts, as_double, cents, day_count, join_parts, ratio, sum_parts
from custoria.operators.horizon import Horizon, eligible, observed

NO_PAYMENT = "None"
DAYS_PER_MONTH = 30


def order_history(orders: DataFrame, span: Horizon, payment: bool = False, together: bool = False) -> DataFrame:
    """One row per customer with both time slices, from one scan of `orders`.

    History and outcome are conditional aggregates of the same grouping, so orders are read and
    shuffled once. With `payment` the grouping is first by (customer, payment method), which
    leaves a handful of rows per customer to merge and from which the most used method falls
    out; even a customer with most of the orders is then cheap. Ties take the lowest name.

    `together` says that orders lie in buckets of customers, so that nothing needs to be shuffled.
    """
    slices = orders.filter(F.col("customer_id").isNotNull()).select(
        "customer_id",
        "payment_method",
        "order_id",
        "order_date",
        "discount_applied",
        cents("order_value").alias("amount"),
        span.seen().alias("seen"),
        span.later().alias("later"),
    )

    def when_seen(column: str) -> Column:
        return F.when(F.col("seen"), F.col(column))

    keys = ["customer_id", "payment_method"] if payment else ["customer_id"]
    base = slices.groupBy(*keys).agg(
        F.count(when_seen("order_id")).alias("total_orders"),
        F.count_if("seen").alias("payments"),
        *sum_parts(when_seen("amount"), "spend"),
        F.count(when_seen("amount")).alias("priced_orders"),
        F.max(when_seen("order_date")).alias("last_order_date"),
        F.min(when_seen("order_date")).alias("first_order_date"),
        F.sum(when_seen("discount_applied")).alias("discount_orders"),
        F.count_if("later").alias("future_orders"),
        *sum_parts(F.when(F.col("later"), F.col("amount")), "future_spend"),
    )
    if payment:
        used = (F.col("payments") > 0) & F.col("payment_method").isNotNull()
        votes = F.when(used, F.struct(-F.col("payments"), F.col("payment_method")))
        # Choosing a name needs a sort by customer. Repartitioning first lets one sort serve both
        # halves of the aggregate and the join that follows.
        base = (base if together else base.repartition("customer_id")).groupBy("customer_id").agg(
            *[F.sum(c).alias(c) for c in ("total_orders", "priced_orders", "discount_orders", "future_orders")],
            *add_parts("spend"),
            *add_parts("future_spend"),
            F.max("last_order_date").alias("last_order_date"),
            F.min("first_order_date").alias("first_order_date"),
            F.min(votes)["payment_method"].alias("preferred_payment"),
        )
    sums = {name: join_parts(f"{name}_high", f"{name}_low") for name in ("spend", "future_spend")}
    parts = [f"{name}_{part}" for name in sums for part in ("high", "low")]
    return base.withColumns(sums).drop("payments", *parts)


def derived(history: DataFrame, span: Horizon) -> DataFrame:
    """Totals as doubles plus the derived recency, tenure and rates; nulls where no history."""
    tenure = day_count("last_order_date", "first_order_date")
    known = F.col("last_order_date").isNotNull()
    return history.select(
        "customer_id",
        F.when(known, F.col("total_orders")).alias("total_orders"),
        as_double(F.when(known, F.coalesce("spend", F.lit(0)))).alias("total_spend"),
        ratio("spend", "priced_orders").alias("avg_order_value"),
        "last_order_date",
        "first_order_date",
        F.col("discount_orders").cast("bigint").alias("discount_orders"),
        day_count(span.cutoff, "last_order_date").alias("recency_days"),
        tenure.alias("tenure_days"),
        ratio("discount_orders", "total_orders").alias("discount_rate"),
        (ratio("total_orders", tenure + 1) * DAYS_PER_MONTH).alias("order_frequency"),
        *[c for c in history.columns if c in ("preferred_payment", "future_orders", "future_spend")],
    )


def rfm(orders: DataFrame, span: Horizon) -> DataFrame:
    """The aggregate of the history slice alone, one row per customer with history."""
    table = derived(order_history(observed(orders, span), span), span)
    return table.drop("future_orders", "future_spend")


def carries_customer(order_items: DataFrame) -> bool:
    """Whether items name their customer, as they do in the layout of `custoria.sources.layout`."""
    return "customer_id" in order_items.columns


def category_diversity(orders: DataFrame, order_items: DataFrame, span: Horizon) -> DataFrame:
    """Number of distinct categories per customer in the history.

    Only keys cross the join. The distinct count merges (customer, category) pairs before they
    are shuffled by customer, so its shuffle is bounded by the pairs, not the items. Items that carry their customer are
    joined by it, too: with both tables in buckets of customers neither join nor count shuffles anything.
    """
    placed = observed(orders, span).filter(F.col("customer_id").isNotNull()).select("order_id", "customer_id")
    keys = ["customer_id", "order_id"] if carries_customer(order_items) else ["order_id"]
    bought = order_items.select(*keys, "category")
    return (
        placed.join(bought, keys)
        .groupBy("customer_id")
        .agg(F.count_distinct("category").alias("category_diversity"))
    )


def preferred_payment(orders: DataFrame, span: Horizon) -> DataFrame:
    """Most used payment method per customer in the history; ties take the lowest name."""
    counts = (
        observed(orders, span)
        .filter(F.col("customer_id").isNotNull() & F.col("payment_method").isNotNull())
        .groupBy("customer_id", "payment_method")
        .agg(F.count(F.lit(1)).alias("uses"))
    )
    best = F.min(F.struct(-F.col("uses"), F.col("payment_method")))
    return counts.repartition("customer_id").groupBy("customer_id").agg(best["payment_method"].alias("preferred_payment"))


# Fixed fill values for customers without history; recency and the outcome have their own rules.
_FILL = {
    "total_orders": 0,
    "total_spend": 0.0,
    "avg_order_value": 0.0,
    "discount_rate": 0.0,
    "order_frequency": 0.0,
    "category_diversity": 0,
    "preferred_payment": NO_PAYMENT,
}


def fill_missing(table: DataFrame, span: Horizon) -> DataFrame:
    """Fill the features of customers without history; dates, tenure and discounts stay null."""
    filled = table.fillna({name: value for name, value in _FILL.items() if name in table.columns})
    since_signup = day_count(span.cutoff, "signup_date")
    return filled.withColumn("recency_days", F.coalesce("recency_days", since_signup))


def churn_features(
    customers: DataFrame,
    orders: DataFrame,
    order_items: DataFrame,
    span: Horizon,
    payment: bool = True,
) -> DataFrame:
    """The customer feature table with its churn label.

    `payment=False` is the variant without the payment method, which needs one shuffle less.
    """
    history = derived(order_history(orders, span, payment, carries_customer(order_items)), span)
    diversity = category_diversity(orders, order_items, span)
    table = (
        eligible(customers, span)
        .join(history, "customer_id", "left")
        .join(diversity, "customer_id", "left")
    )
    returned = F.coalesce("future_orders", F.lit(0)) > 0
    labelled = fill_missing(table, span).withColumn("churned", (~returned).cast("int"))
    return labelled.select(
        *customers.columns,
        "total_orders",
        "total_spend",
        "avg_order_value",
        "last_order_date",
        "first_order_date",
        "discount_orders",
        "recency_days",
        "tenure_days",
        "discount_rate",
        "order_frequency",
        "category_diversity",
        *(["preferred_payment"] if payment else []),
        "churned",
    )


def spend_features(customers: DataFrame, orders: DataFrame, span: Horizon) -> DataFrame:
    """History features and the spend of the outcome window, one row per eligible customer."""
    history = derived(order_history(orders, span), span)
    target = f"future_{span.window_days}d_spend"
    table = eligible(customers, span).join(history, "customer_id", "left")
    return (
        fill_missing(table, span)
        .withColumn(target, as_double(F.coalesce("future_spend", F.lit(0))))
        .select(
            *customers.columns,
            "total_orders",
            "total_spend",
            "avg_order_value",
            "last_order_date",
            "first_order_date",
            "recency_days",
            "tenure_days",
            "order_frequency",
            target,
        )
    )
