"""The shop and visit tables as views over a star-schema warehouse.

Each view is a plain projection, so column pruning and filters reach its Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from custoria.sources.readers import Shop

# Fixed values of the mapping from warehouse keys to customer attributes.
FIRST_SIGNUP = "1995-01-01"
SIGNUP_STEP, SIGNUP_SPAN_DAYS = 37, 2400
MIN_AGE, AGE_SPAN = 18, 47


# Fixed types of the warehouse columns in use: no job to look them up, no other column read.
_COLUMNS = {
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_quantity double",
    "part": "p_partkey bigint, p_type string, p_retailprice double",
    "events": "event_id bigint, ts timestamp_ntz, event_type string, value double",
}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(_COLUMNS[name]).parquet(f"{folder}/{name}.parquet")


def _signup_date(customer_key: str) -> Column:
    offset = (F.col(customer_key) * SIGNUP_STEP) % SIGNUP_SPAN_DAYS
    return F.date_add(F.lit(FIRST_SIGNUP).cast("date"), offset.cast("int"))


def customers(spark: SparkSession, folder: str) -> DataFrame:
    people = _table(spark, folder, "customer")
    nations = _table(spark, folder, "nation")
    return people.join(nations, people.c_nationkey == nations.n_nationkey).select(
        F.col("c_custkey").alias("customer_id"),
        _signup_date("c_custkey").alias("signup_date"),
        F.col("n_name").alias("city"),
        (F.lit(MIN_AGE) + F.col("c_custkey") % AGE_SPAN).cast("int").alias("age"),
        F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M").alias("gender"),
        F.col("c_mktsegment").alias("acquisition_channel"),
    )


def orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of known customers, none before its customer signed up.

    The signup date follows from the key, so the filter runs before the semi join shuffles.
    """
    placed = _table(spark, folder, "orders").filter(
        F.col("o_orderdate").cast("date") >= _signup_date("o_custkey")
    )
    known = _table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return placed.join(known, "o_custkey", "left_semi").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.col("o_totalprice").alias("order_value"),
        (F.col("o_orderstatus") == "P").cast("int").alias("discount_applied"),
        F.col("o_orderpriority").alias("payment_method"),
    )


def order_items(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with their product's category; the source has no unique item id."""
    lines = _table(spark, folder, "lineitem")
    parts = _table(spark, folder, "part")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.col("l_orderkey").alias("order_id"),
        F.col("p_type").alias("category"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("p_retailprice").alias("item_price"),
    )


def visits(spark: SparkSession, folder: str, experiment: str = "daily") -> DataFrame:
    """Events as experiment visits: one experiment per day, or `all` of them as one."""
    bought = F.col("event_type") == "purchase"
    name = F.date_format("ts", "yyyy-MM-dd") if experiment == "daily" else F.lit("all")
    return _table(spark, folder, "events").select(
        name.alias("experiment_id"),
        F.when(F.col("event_id") % 2 == 1, "treatment").otherwise("control").alias("variant"),
        bought.cast("int").alias("converted"),
        F.when(bought, F.col("value")).alias("order_value"),
    )


def shop(spark: SparkSession, folder: str) -> Shop:
    return Shop(customers(spark, folder), orders(spark, folder), order_items(spark, folder))
