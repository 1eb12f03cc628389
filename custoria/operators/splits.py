"""Repeatable train / test splits that depend on the row key only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from custoria.functions.columns import KEY_HASH_SPAN, key_hash
from custoria.operators.bounds import sized

TEST_SHARE = 0.25
SEED = 42
_BUCKET_BITS = 14


def random_split(table: DataFrame, key: str, share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Add `is_test` for about `share` of the rows: a threshold on the key's hash, no shuffle."""
    return table.withColumn("is_test", key_hash(seed, key) < int(share * KEY_HASH_SPAN))


def stratified_split(
    table: DataFrame, key: str, label: str, share: float = TEST_SHARE, seed: int = SEED
) -> DataFrame:
    """Add `is_test` for exactly ceil(share * n) rows, each class in proportion.

    The test rows of a class are those with the lowest (hash, key). Their exact last row is found
    without sorting the class: counts per hash bucket tell in which bucket it lies, and only that
    bucket is ranked. The tables of classes are saved, so that joins see how small they are; it feeds
    three branches, so pass a saved one.
    """
    hashed = table.withColumn("_hash", key_hash(seed, key))
    bucket = F.shiftright("_hash", 60 - _BUCKET_BITS)
    sizes = hashed.groupBy(label, bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))

    # At most classes x 2^14 rows from here to `edges`.
    sizes = sized(sizes, "class-buckets")
    upto = Window.partitionBy(label).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    reached = sizes.withColumn("_upto", F.sum("_n").over(upto))
    quotas = _quotas(sizes, label, share)
    edges = (
        reached.join(quotas, label)
        .filter((F.col("_upto") - F.col("_n") < F.col("_quota")) & (F.col("_quota") <= F.col("_upto")))
        .select(label, "_bucket", (F.col("_quota") - F.col("_upto") + F.col("_n")).alias("_rank"))
    )
    in_bucket = Window.partitionBy(label).orderBy("_hash", key)
    last = (
        hashed.select(label, key, "_hash", bucket.alias("_bucket"))
        .join(sized(edges, "edges"), [label, "_bucket"])
        .withColumn("_place", F.row_number().over(in_bucket))
        .filter(F.col("_place") == F.col("_rank"))
        .select(label, F.col("_hash").alias("_last_hash"), F.col(key).alias("_last_key"))
    )
    chosen = F.struct("_hash", key) <= F.struct("_last_hash", "_last_key")
    return (
        hashed.join(sized(last, "last-rows"), label, "left")
        .withColumn("is_test", F.coalesce(chosen, F.lit(False)))
        .drop("_hash", "_last_hash", "_last_key")
    )


def _quotas(sizes: DataFrame, label: str, share: float) -> DataFrame:
    """Test rows per class: proportional, whole numbers, the rest to the largest remainders."""
    classes = sizes.groupBy(label).agg(F.sum("_n").cast("decimal(18,0)").alias("_rows"))
    whole = Window.partitionBy(F.lit(1))  # one row per class
    total = F.sum("_rows").over(whole)
    wanted = F.ceil(F.lit(share) * total.cast("double")).cast("decimal(18,0)")
    exact = classes.select(
        label, total.alias("_total"), wanted.alias("_wanted"), (F.col("_rows") * wanted).alias("_scaled")
    )
    parts = exact.select(
        label,
        "_wanted",
        (F.col("_scaled") % F.col("_total")).alias("_rest"),
        F.floor(F.col("_scaled") / F.col("_total")).cast("bigint").alias("_floor"),
    )
    spare = F.col("_wanted") - F.sum("_floor").over(whole)
    turn = F.row_number().over(whole.orderBy(F.desc("_rest"), label))
    return parts.select(label, (F.col("_floor") + (turn <= spare).cast("bigint")).alias("_quota"))
