"""Churn labels, rates and the sweep over window lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from custoria.functions.columns import ratio
from custoria.operators.horizon import Horizon, eligible, outcome

SWEEP_DAYS = tuple(range(30, 181, 15))


def future_buyers(orders: DataFrame, span: Horizon) -> DataFrame:
    """Distinct customers with an order in the outcome window."""
    return outcome(orders, span).select("customer_id").filter(F.col("customer_id").isNotNull()).distinct()


def churn_labels(customers: DataFrame, orders: DataFrame, span: Horizon) -> DataFrame:
    """0 for eligible customers who bought in the outcome window, else 1."""
    buyers = future_buyers(orders, span).withColumn("returned", F.lit(True))
    return (
        eligible(customers, span)
        .select("customer_id")
        .join(buyers, "customer_id", "left")
        .select("customer_id", F.col("returned").isNull().cast("int").alias("churned"))
    )


def returning(customers: DataFrame, orders: DataFrame, span: Horizon) -> DataFrame:
    """Eligible customers who bought again."""
    return eligible(customers, span).join(future_buyers(orders, span), "customer_id", "left_semi")


def lost(customers: DataFrame, orders: DataFrame, span: Horizon) -> DataFrame:
    """Eligible customers who did not."""
    return eligible(customers, span).join(future_buyers(orders, span), "customer_id", "left_anti")


def class_summary(labels: DataFrame, label: str = "churned") -> DataFrame:
    """Sizes of both classes, the rate of class 1 and the balance 0 : 1."""
    return labels.agg(
        F.count(label).alias("customers"),
        F.count_if(F.col(label) == 0).alias("negatives"),
        F.count_if(F.col(label) == 1).alias("positives"),
    ).select(
        "*",
        ratio("positives", "customers").alias("positive_rate"),
        ratio("negatives", "positives").alias("balance"),
        ratio("negatives", F.greatest("positives", F.lit(1))).alias("balance_guarded"),
    )


def churn_sweep(customers: DataFrame, orders: DataFrame, windows: tuple[int, ...] = SWEEP_DAYS) -> DataFrame:
    """Churn rate for every window length, from one row per customer.

    No order is later than the last date, so a customer has churned exactly if their last order
    is missing or not after the cutoff. Orders are reduced to that one date and shuffled once;
    every window is then a pair of conditional counts in a single global aggregate.
    """
    end = orders.agg(F.max("order_date")).scalar()
    last = (
        orders.filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(F.max("order_date").alias("last_order"))
    )
    age = (
        customers.select("customer_id", "signup_date")
        .join(last, "customer_id", "left")
        .select(
            F.datediff(end, "signup_date").alias("signup_age"),
            F.datediff(end, "last_order").alias("silent_days"),
        )
    )
    counts = []
    for days in windows:
        there = F.col("signup_age") >= days
        gone = F.col("silent_days").isNull() | (F.col("silent_days") >= days)
        counts += [
            F.count_if(there).alias(f"n{days}"),
            F.count_if(there & gone).alias(f"c{days}"),
        ]
    cells = ", ".join(f"{days}, n{days}, c{days}" for days in windows)
    return age.agg(*counts).selectExpr(
        f"stack({len(windows)}, {cells}) as (window_days, eligible, churned)"
    ).select("*", ratio("churned", "eligible").alias("churn_rate"))
