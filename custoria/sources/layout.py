"""A saved layout of the shop in which the joins and groupings of a customer need no shuffle.

Customers, orders and order items are written into the same number of buckets by customer, sorted within each; an item
carries the customer of its order. A bucket of one table then meets the same bucket of the others where they lie.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from custoria.sources import files
from custoria.sources.readers import Shop
from custoria.sources.reuse import settle

KEY = "customer_id"
#: Sort columns per table: a bucket is read in the order its joins and groupings want.
ORDER = {"customers": [KEY], "orders": [KEY, "order_id"], "order_items": [KEY, "order_id"]}
#: Rows of the three tables that a bucket should hold: one task sorts and groups them.
BUCKET_ROWS = 1_000_000
#: A largest bucket with more than this many times the mean is hot: Spark does not split the scan of a bucket.
HOT = 4


def write_layout(shop: Shop, folder: str, buckets: int | None = None) -> Shop:
    """Write the shop below `folder` (shared, empty) and open it.

    Without `buckets` their number follows from the rows. Every row is kept: items of an unknown order, and orders without
    customer, have a null customer. If one bucket would be hot, since one customer has a large share of all rows, the
    tables are written without buckets and items without their customer; joins then shuffle, and split hot keys.
    """
    spark = shop.orders.sparkSession
    owner = shop.orders.groupBy("order_id").agg(F.min(KEY).alias(KEY))
    # The join is settled, as it is counted and then written.
    items = settle(shop.order_items.join(owner, "order_id", "left"), "layout-items")
    tables = {"customers": shop.customers, "orders": shop.orders, "order_items": items}
    weights = {name: table.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")) for name, table in tables.items()}
    per_key = settle(weights["orders"].unionByName(weights["order_items"]).unionByName(weights["customers"]), "layout-keys")
    rows = per_key.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    number = buckets or max(1, -(-rows // BUCKET_ROWS))
    fullest = (
        per_key.groupBy(F.pmod(F.hash(KEY), F.lit(number)).alias("bucket"))
        .agg(F.sum("n").alias("n"))
        .agg(F.coalesce(F.max("n"), F.lit(0)))
        .first()[0]
    )
    if number > 1 and fullest * number > HOT * rows:
        number = 0
    for name, table in tables.items():
        if not number:
            (table.drop(KEY) if name == "order_items" else table).write.parquet(f"{folder}/{name}")
            continue
        # Buckets are chosen by the hash that partitions are, so each becomes one file, which stays sorted when read.
        writer = table.repartition(number, KEY).write.format("parquet").bucketBy(number, KEY).sortBy(*ORDER[name])
        _forget(spark, folder, name)
        writer.option("path", f"{folder}/{name}").saveAsTable(_table_name(folder, name))
    spark.createDataFrame([(number,)], "buckets int").coalesce(1).write.json(f"{folder}/layout")
    return open_layout(spark, folder)


def open_layout(spark: SparkSession, folder: str) -> Shop:
    """The shop that `write_layout` left in `folder`, in this or another session.

    A join of orders and items on both their customer and their order may use the buckets only if Spark accepts
    partitions by one of several join keys; this is set for the session here.
    """
    if not files.committed(spark, f"{folder}/layout"):
        raise FileNotFoundError(f"{folder} holds no complete layout")
    number = spark.read.schema("buckets int").json(f"{folder}/layout").first()[0]
    if not number:
        return Shop(*[spark.read.parquet(f"{folder}/{name}") for name in ORDER])
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return Shop(*[_bucketed(spark, folder, name, number) for name in ORDER])


def _table_name(folder: str, name: str) -> str:
    return f"layout_{hashlib.md5(folder.encode()).hexdigest()[:16]}_{name}"


def _bucketed(spark: SparkSession, folder: str, name: str, number: int) -> DataFrame:
    table, path = _table_name(folder, name), f"{folder}/{name}"
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({', '.join(ORDER[name])})"
            f" INTO {number} BUCKETS LOCATION '{path}'"
        )
    return spark.table(table)


def _forget(spark: SparkSession, folder: str, name: str) -> None:
    """Take an earlier layout of the same folder out of the catalogue; its files stay."""
    spark.sql(f"DROP TABLE IF EXISTS {_table_name(folder, name)}")
