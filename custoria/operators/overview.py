"""Totals and mixes of the whole shop."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from custoria.functions.columns import (
    add_parts,
    as_double,
    cents,
    cents_sum,
    join_parts,
    money_sum,
    month_label,
    month_of,
    ratio,
    sum_parts,
)
from custoria.sources.readers import Shop


def profile(shop: Shop) -> DataFrame:
    """Row count and date span of every table."""

    def span(name: str, frame: DataFrame, date: str | None) -> DataFrame:
        first, last = (F.min(date), F.max(date)) if date else (F.lit(None), F.lit(None))
        return frame.agg(
            F.count(F.lit(1)).alias("row_count"),
            first.cast("date").alias("first_date"),
            last.cast("date").alias("last_date"),
        ).select(F.lit(name).alias("table_name"), "row_count", "first_date", "last_date")

    return reduce(
        DataFrame.unionByName,
        [
            span("customers", shop.customers, "signup_date"),
            span("orders", shop.orders, "order_date"),
            span("order_items", shop.order_items, None),
        ],
    )


def kpis(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Customers, orders, revenue and average order value, in one row."""
    people = customers.agg(F.count(F.lit(1)).alias("n")).scalar()
    totals = orders.agg(
        F.count(F.lit(1)).alias("total_orders"),
        money_sum("order_value").alias("revenue"),
        F.count("order_value").alias("priced"),
    )
    return totals.select(
        people.alias("total_customers"),
        "total_orders",
        as_double(F.coalesce("revenue", F.lit(0))).alias("total_revenue"),
        ratio("revenue", "priced").alias("avg_order_value"),
    )


def order_totals(orders: DataFrame) -> DataFrame:
    """Orders, priced orders and revenue parts per (month, payment method): all the overview needs, in one pass."""
    return orders.groupBy(month_of("order_date").alias("first_day"), "payment_method").agg(
        F.count(F.lit(1)).alias("orders"),
        F.count("order_value").alias("priced"),
        *sum_parts(cents("order_value"), "revenue"),
    )


def kpis_of(customers: DataFrame, totals: DataFrame) -> DataFrame:
    """`kpis` from order totals."""
    people = customers.agg(F.count(F.lit(1)).alias("n")).scalar()
    parts = totals.agg(F.sum("orders").alias("orders"), F.sum("priced").alias("priced"), *add_parts("revenue"))
    revenue = join_parts("revenue_high", "revenue_low")
    return parts.select(
        people.alias("total_customers"),
        F.coalesce("orders", F.lit(0)).alias("total_orders"),
        as_double(F.coalesce(revenue, F.lit(0))).alias("total_revenue"),
        ratio(revenue, "priced").alias("avg_order_value"),
    )


def months_of(totals: DataFrame) -> DataFrame:
    """`revenue_by_month` from order totals."""
    revenue = F.coalesce(join_parts(*add_parts("revenue")), F.lit(0))
    return (
        totals.filter(F.col("first_day").isNotNull())
        .groupBy("first_day")
        .agg(as_double(revenue).alias("order_value"))
        .select(month_label("first_day").alias("month"), "order_value")
        .orderBy("month")
    )


def payments_of(totals: DataFrame) -> DataFrame:
    """The payment mix from order totals."""
    return (
        totals.filter(F.col("payment_method").isNotNull())
        .groupBy(F.col("payment_method").alias("method"))
        .agg(F.sum("orders").alias("count"))
        .orderBy(F.desc("count"), "method")
    )


def line_revenue(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """Items of existing orders with price x quantity, in hundredths."""
    return order_items.join(orders.select("order_id"), "order_id").withColumn(
        "revenue_cents", cents("item_price") * F.col("quantity")
    )


def revenue_by_category(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """Revenue per category, highest first."""
    return (
        line_revenue(orders, order_items)
        .filter(F.col("category").isNotNull())
        .groupBy("category")
        .agg(as_double(F.coalesce(cents_sum("revenue_cents"), F.lit(0))).alias("revenue"))
        .orderBy(F.desc("revenue"), "category")
    )


def revenue_by_month(orders: DataFrame) -> DataFrame:
    """Revenue per calendar month, as `yyyy-MM`."""
    return (
        orders.filter(F.col("order_date").isNotNull())
        .groupBy(F.trunc("order_date", "MM").alias("first_day"))
        .agg(as_double(F.coalesce(money_sum("order_value"), F.lit(0))).alias("order_value"))
        .select(month_label("first_day").alias("month"), "order_value")
        .orderBy("month")
    )


def mix(frame: DataFrame, column: str, label: str, count: str = "count") -> DataFrame:
    """Frequency of each value, most frequent first; nulls are not counted."""
    return (
        frame.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias(label))
        .agg(F.count(F.lit(1)).alias(count))
        .orderBy(F.desc(count), label)
    )
