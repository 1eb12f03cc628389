"""The time line of a churn or spend question: history, cutoff, outcome window."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Horizon:
    """Last order date of the data, and the cutoff `window_days` before it, as scalar columns."""

    max_date: Column
    cutoff: Column
    window_days: int

    def seen(self, date: str = "order_date") -> Column:
        """Up to the cutoff, the cutoff day included."""
        return F.col(date) <= self.cutoff

    def later(self, date: str = "order_date") -> Column:
        """After the cutoff and up to the last date."""
        return (F.col(date) > self.cutoff) & (F.col(date) <= self.max_date)


def horizon(orders: DataFrame, window_days: int = 90, as_of: dt.date | str | None = None) -> Horizon:
    """The horizon of `orders`.

    Without `as_of` the last date is a scalar subquery that reads the date column only and runs
    inside the same job. With `as_of` both dates are literals, which Parquet filters and
    partition pruning can use; orders after it then belong to neither slice.
    """
    if as_of is None:
        last = orders.agg(F.max("order_date")).scalar()
    else:
        last = F.lit(str(as_of)).cast("date")
    return Horizon(last, F.date_sub(last, window_days), window_days)


def last_date(orders: DataFrame) -> dt.date | None:
    """The last order date, found once: as `as_of` it makes every later cutoff a literal that filters a scan."""
    return orders.agg(F.max("order_date")).first()[0]


def last_date_in_files(spark: SparkSession, path: str, column: str = "order_date") -> dt.date | None:
    """The last date of the Parquet files at `path`, from the statistics in their footers: no page is read.

    Null dates do not count; a table without any date, or without rows, has none. Where a part of a file has no statistics,
    since it holds nulls only or was written without them, the column is read instead.
    """
    try:
        return newest_in_files(spark, path, column).first()[0]
    except Exception as error:
        if "No min/max found" not in str(error):
            raise
        return spark.read.parquet(path).agg(F.max(column)).first()[0]


def newest_in_files(spark: SparkSession, path: str, column: str) -> DataFrame:
    """The largest value of a column as an aggregate that the Parquet source answers itself.

    Only the second version of the source can do that. It is chosen in a session of its own, which shares this one's
    executors but not its settings, so no other scan changes its plan.
    """
    footers = spark.newSession()
    footers.conf.set("spark.sql.sources.useV1SourceList", "")
    footers.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return footers.read.parquet(path).agg(F.max(column).alias(column))


def observed(orders: DataFrame, span: Horizon) -> DataFrame:
    """Orders that features may use."""
    return orders.filter(span.seen())


def outcome(orders: DataFrame, span: Horizon) -> DataFrame:
    """Orders that only labels may use."""
    return orders.filter(span.later())


def eligible(customers: DataFrame, span: Horizon) -> DataFrame:
    """Customers who had signed up by the cutoff."""
    return customers.filter(F.col("signup_date") <= span.cutoff)
