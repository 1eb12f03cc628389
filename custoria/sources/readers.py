"""Typed scans of CSV and Parquet tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from custoria.sources.schemas import TABLES


class SchemaError(ValueError):
    """A table lacks a column that its contract names."""


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """Read `path` as `schema`: columns found by name, in any order, extra ones ignored.

    CSV types are never inferred. Only the header line is read to learn the column order; a
    value that does not fit its type stops the job instead of turning into a null.
    A path that does not exist raises Spark's AnalysisException.
    """
    wanted = {field.name: field for field in schema}
    if fmt == "csv":
        header = spark.read.option("header", True).csv(path).columns
        _require(path, wanted, header)
        in_file = T.StructType([wanted.get(name, T.StructField(name, T.StringType())) for name in header])
        frame = (
            spark.read.schema(in_file)
            .option("header", True)
            .option("mode", "FAILFAST")
            .option("dateFormat", "yyyy-MM-dd")
            .csv(path)
        )
    else:
        frame = spark.read.format(fmt).load(path)
        _require(path, wanted, frame.columns)
    return frame.select(*[F.col(name).cast(field.dataType).alias(name) for name, field in wanted.items()])


def _require(path: str, wanted: dict, found: list[str]) -> None:
    missing = [name for name in wanted if name not in found]
    if missing:
        raise SchemaError(f"{path} lacks the columns {missing}")


@dataclass(frozen=True)
class Shop:
    """The three related tables: customers 1-N orders 1-N order_items."""

    customers: DataFrame
    orders: DataFrame
    order_items: DataFrame


def open_shop(spark: SparkSession, folder: str, fmt: str = "csv") -> Shop:
    """Open customers, orders and order_items below `folder`."""
    suffix = {"csv": ".csv", "parquet": ".parquet"}.get(fmt, "")
    return Shop(
        *[
            read_table(spark, f"{folder}/{name}{suffix}", TABLES[name], fmt)
            for name in ("customers", "orders", "order_items")
        ]
    )


def open_visits(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Open a table of experiment visits, one row per visit."""
    return read_table(spark, path, TABLES["visits"], fmt)
