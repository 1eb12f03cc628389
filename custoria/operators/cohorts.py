"""Signup-month cohorts: who stays active and what they have spent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from custoria.functions.columns import (
    add_parts,
    as_double,
    cents,
    join_parts,
    month_of,
    months_between,
    ratio,
    sum_parts,
)


def signup_cohorts(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders with their customer's cohort month and the months since signup."""
    signups = customers.select("customer_id", "signup_date")
    return orders.join(signups, "customer_id").select(
        *orders.columns,
        month_of("signup_date").alias("cohort_month"),
        month_of("order_date").alias("order_month"),
        months_between("order_date", "signup_date").alias("cohort_index"),
    )


def cohort_cells(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Active customers, revenue and cohort size for every (cohort month, cohort index).

    Orders shrink to one row per customer and month before anything else, so neither a customer
    nor a cohort with a large share of the orders ends up in one task: distinct customers are
    then plain row counts. The size counts the cohort's purchasers: each one once, in the month
    of their first order.
    """
    monthly = (
        orders.filter(F.col("customer_id").isNotNull() & F.col("order_date").isNotNull())
        .groupBy("customer_id", month_of("order_date").alias("order_month"))
        .agg(*sum_parts(cents("order_value"), "revenue"))
    )
    own_months = Window.partitionBy("customer_id")
    flagged = monthly.withColumn("is_first", F.col("order_month") == F.min("order_month").over(own_months))
    signups = customers.select("customer_id", "signup_date").filter(F.col("signup_date").isNotNull())
    cells = (
        flagged.join(signups, "customer_id")
        .groupBy(
            month_of("signup_date").alias("cohort_month"),
            months_between("order_month", "signup_date").alias("cohort_index"),
        )
        .agg(
            F.count(F.lit(1)).alias("active_customers"),
            F.coalesce(join_parts(*add_parts("revenue")), F.lit(0)).alias("revenue"),
            F.count_if("is_first").alias("new_customers"),
        )
    )
    # From here on there are at most (months x months) rows.
    size = F.sum("new_customers").over(Window.partitionBy("cohort_month"))
    return cells.select(
        "cohort_month", "cohort_index", "active_customers", "revenue", size.alias("cohort_size")
    )


def retention(cells: DataFrame) -> DataFrame:
    """Share of the cohort that is active in each month."""
    return cells.select(
        "cohort_month",
        "cohort_index",
        "active_customers",
        "cohort_size",
        ratio("active_customers", "cohort_size").alias("retention"),
    )


def cumulative_revenue(cells: DataFrame) -> DataFrame:
    """Running revenue per purchaser of the cohort; silent months have no row."""
    so_far = Window.partitionBy("cohort_month").orderBy("cohort_index")
    running = F.sum("revenue").over(so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return cells.select(
        "cohort_month",
        "cohort_index",
        "cohort_size",
        as_double("revenue").alias("revenue"),
        as_double(running).alias("cumulative_revenue"),
        ratio(running, "cohort_size").alias("avg_cumulative_revenue"),
    )
