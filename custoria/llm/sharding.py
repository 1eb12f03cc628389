"""Rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair has a number u in (0, 1) from its SHA-256; a key goes to the shard with the least -ln(u) / weight.
Each shard so wins keys in proportion to its weight, and the others' numbers do not change when a shard comes or goes: one
more shard takes keys only into itself, a lost one gives up only its own, a changed weight moves keys only to or from its
shard. Assigning needs no shuffle and no table of keys: any reader computes a record's shard from its key.

Positions inside a shard are counted over distinct rows: equal rows are combined before they are shuffled, shards are cut
into ranges of the key's own hash, and only a range is ever sorted, so neither a shard nor a repeated key meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custoria.llm.common import prepare, settle, text_column

#: Bits of a digest that become a number; a double holds them all.
BITS = 52
#: Bytes a record takes besides its text.
OVERHEAD = 16
#: Distinct rows of a shard, about, that one task sorts.
RANGE_ROWS = 2_000
#: The law that holds: key and number of shards decide alone.
LAW = "key"


def even(shards: int) -> dict[int, float]:
    """Shards 0.. of equal weight."""
    return {shard: 1.0 for shard in range(shards)}


def hash_number(text: Column) -> Column:
    """The first 52 bits of the SHA-256 of a text."""
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, BITS // 4), 16, 10).cast("bigint")


def key_text(key: str) -> Column:
    return F.coalesce(F.col(key).cast("string"), F.lit(""))


def shard_of(key: Column, weights: dict[int, float]) -> Column:
    """The shard of a key (a string) among `weights`; shards of weight 0 get nothing."""
    if any(w < 0 for w in weights.values()) or not any(weights.values()):
        raise ValueError("weights are not negative, and one at least is positive")
    shards = F.array(*(F.struct(F.lit(s).alias("shard"), F.lit(float(w)).alias("weight")) for s, w in sorted(weights.items()) if w))

    def scored(shard: Column) -> Column:
        u = (hash_number(F.concat_ws(":", key, shard["shard"].cast("string"))) + 0.5) / float(1 << BITS)
        return F.struct((-F.log(u) / shard["weight"]).alias("score"), shard["shard"].alias("shard"))

    return F.array_min(F.transform(shards, scored))["shard"]


def assign(documents: DataFrame, weights: dict[int, float], key: str = "doc_id", name: str = "shard") -> DataFrame:
    """`documents` with the column `name`. Rows with equal keys share a shard; a null key counts as empty. Stays in place."""
    prepare(documents.sparkSession)
    return documents.withColumn(name, shard_of(key_text(key), weights))


def moves(documents: DataFrame, before: dict[int, float], after: dict[int, float], key: str = "doc_id") -> DataFrame:
    """(source, target, n): how many rows leave which shard for which when the shards change."""
    both = documents.select(shard_of(key_text(key), before).alias("source"), shard_of(key_text(key), after).alias("target"))
    return both.filter("source <> target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


def slots(rows: DataFrame, place: str, order: list[str], shard: str = "shard", range_rows: int = RANGE_ROWS) -> DataFrame:
    """`rows` with `slot`: their positions in their shards, gapless from 0, by `place` (52 bits of a hash), then `order`.

    Rows that are equal in all columns get slots one after the other. They are combined per partition of the saved input,
    so a row repeated ever so often arrives as few counts, and is only multiplied once its slots are known.
    """
    spark = prepare(rows.sparkSession)
    columns = rows.columns
    part, n, start = "_part", "_n", "_start"
    counts = settle(rows.withColumn(part, F.spark_partition_id()).groupBy(*columns, part).agg(F.count(F.lit(1)).alias(n)), "slots")
    shards = Window.partitionBy(shard).orderBy("_range")
    total = counts.count()
    bits = max(0, (total // range_rows).bit_length())
    ranged = counts.withColumn("_range", F.shiftright(F.col(place), BITS - bits))
    sums = ranged.groupBy(shard, "_range").agg(F.sum(n).alias("_in"))
    sums = sums.select(shard, "_range", (F.sum("_in").over(shards) - F.col("_in")).alias("_before"))
    within = Window.partitionBy(shard, "_range").orderBy(place, *order, part).rowsBetween(Window.unboundedPreceding, -1)
    counted = ranged.withColumn("_inside", F.coalesce(F.sum(n).over(within), F.lit(0)))
    started = settle(
        counted.join(sums, [shard, "_range"]).select(*columns, n, (F.col("_before") + F.col("_inside")).alias(start)), "starts"
    )
    once = started.filter(F.col(n) == 1).select(*columns, F.col(start).alias("slot"))
    many = started.filter(F.col(n) > 1).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), start, shard)
    return once.unionByName(many.select(*columns, F.explode(F.sequence(F.col(start), F.col(start) + F.col(n) - 1)).alias("slot")))


def placed(documents: DataFrame, shards: int = 40, key: str = "doc_id") -> DataFrame:
    """One row per row of `documents`: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size counts the text's UTF-8 bytes and 16 more, text_crc32 is unsigned; a null text has none. grown_shard is the shard
    when there is one more: the same, or the new one. Slots go by the key's hash, then id, size and checksum. The key alone
    decides: repeated rows share a shard, copies of a text under other ids do not. No rows give no rows.
    """
    prepare(documents.sparkSession)
    text = text_column()
    now = key_text(key)
    rows = documents.select(
        F.col("doc_id"),
        (F.octet_length(text).cast("bigint") + OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_of(now, even(shards)).alias("shard"),
        shard_of(now, even(shards + 1)).alias("grown_shard"),
        hash_number(now).alias("place"),
    )
    return slots(rows, "place", ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", "grown_shard"
    )


def write_shards(documents: DataFrame, path: str, weights: dict[int, float], key: str = "doc_id") -> None:
    """Whole rows as Parquet, a folder `shard=K` each. Large shards are split over several tasks and files."""
    assign(documents, weights, key).hint("rebalance", "shard").write.mode("overwrite").partitionBy("shard").parquet(path)
