"""How a set of document filters interact: what each one removes after any others, over all orders.

A document's failures are a mask of bits, so a part of the corpus is 32 cells (mask, counts) whatever its size. A recursive
common table expression enumerates the orders: it starts from the empty prefix of every part and extends each prefix by every
letter not yet used, joins the part's cells, carries the applied bits along, and emits the metrics of that step. Five
levels give all 325 prefixes of the 120 orders; an order's steps are its five prefixes.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custoria.llm.common import prepare, settle, text_column

FILTERS = "ABCDE"
_SPACE = r"[\x20\x09-\x0D]+"
_LIMIT = "spark.sql.cteRecursionRowLimit"
_BITS = {letter: 1 << place for place, letter in enumerate(FILTERS)}


def _bit(fails: Column, letter: str) -> Column:
    return F.when(fails, F.lit(_BITS[letter])).otherwise(F.lit(0))


def text_failures(text: Column) -> Column:
    """The mask of filters A to D, which a text fails by itself. The empty text fails A alone."""
    words = F.array_remove(F.split(text, _SPACE), "")
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = {
        "A": F.size(words) < 100,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 80,
        "C": capitals.cast("bigint") * 100 > F.char_length(text).cast("bigint") * 10,
        "D": text.rlike("[#$%&*|]"),
    }
    bits = [_bit(fails[letter], letter) for letter in "ABCD"]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def failures(documents: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, mask) of every row. Texts are read once; their facts are saved.

    E is failed by a row whose text some smaller doc_id has. Texts are compared by SHA-256. The least id of a text is
    combined before the shuffle, and a text that very many rows hold is split by Spark's skew join.
    """
    prepare(documents.sparkSession)
    text = text_column()
    facts = settle(
        documents.select(
            "doc_id",
            F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
            text_failures(text).alias("own"),
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"),
        ),
        "facts",
    )
    repeated = facts.groupBy("sha").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = F.coalesce(F.col("least") < F.col("doc_id"), F.lit(False))
    return facts.join(repeated, "sha", "left").select("doc_id", "part", F.col("own").bitwiseOR(_bit(later, "E")).alias("mask"))


def cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents per cell, and those that a label calls good or toxic.

    A document is good or toxic if any of its label rows says so; without a row it is neither.
    """
    marked = labels.groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    joined = masks.join(marked.filter("good or toxic"), "doc_id", "left")
    return joined.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("good")).alias("good"), F.count_if(F.col("toxic")).alias("toxic")
    )


_WALK = """
WITH RECURSIVE walk (part, prefix, applied, bit, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
  SELECT part, CAST('' AS STRING), 0, 0, 0, 0L, 0L, 0L, 0L, 0L, 0L FROM {parts}
  UNION ALL
  SELECT part, concat(prefix, letter), applied | bit, bit, step,
         aggregate(filter(cells, x -> x.mask & (applied | bit) = 0), 0L, (t, x) -> t + x.n),
         aggregate(here, 0L, (t, x) -> t + x.n),
         aggregate(filter(cells, x -> x.mask & bit <> 0 AND x.mask & applied <> 0), 0L, (t, x) -> t + x.n),
         aggregate(filter(cells, x -> x.mask = bit), 0L, (t, x) -> t + x.n),
         aggregate(here, 0L, (t, x) -> t + x.good),
         aggregate(here, 0L, (t, x) -> t + x.toxic)
  FROM (SELECT part, prefix, applied, step, cells, f.letter AS letter, f.bit AS bit,
               filter(cells, x -> x.mask & f.bit <> 0 AND x.mask & applied = 0) AS here
        FROM (SELECT w.part, w.prefix, w.applied, w.step + 1 AS step, p.cells,
                     explode(filter({filters}, f -> f.bit & w.applied = 0)) AS f
              FROM walk w JOIN {parts} p ON p.part = w.part)))
SELECT part, prefix, bit, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost FROM walk WHERE step > 0"""


def prefix_metrics(counted: DataFrame) -> DataFrame:
    """One row per part and prefix of an order, with the metrics of the prefix's last step.

    The recursion carries one row per part and prefix, a part's cells being an array of 32 at most. It is written here, as
    its number of rows, 326 a part, must not meet Spark's limit on recursion.
    """
    spark = prepare(counted.sparkSession)
    parts = settle(counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")), "cells")
    filters = "array(" + ", ".join(f"struct('{letter}' AS letter, {bit} AS bit)" for letter, bit in _BITS.items()) + ")"
    before = spark.conf.get(_LIMIT)
    spark.conf.set(_LIMIT, "-1")
    try:
        return settle(spark.sql(_WALK.replace("{filters}", filters), parts=parts), "walk")
    finally:
        spark.conf.set(_LIMIT, before)


def audit(documents: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step.

    part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley; counts of documents
    within the part, zeros included. Rows with a null part form the part ''. Repeated rows count as often as they occur
    (none of them repeats a smaller id); a null id is smaller than none and has no label. No documents give no rows.
    """
    walk = prefix_metrics(cells(failures(documents, part), labels))
    orders = ["".join(p) for p in permutations(FILTERS)]
    steps = walk.withColumn("filter_order", F.explode(F.filter(F.array(*map(F.lit, orders)), lambda o: o.startswith(F.col("prefix")))))
    shapley = steps.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return steps.join(shapley, ["part", "bit"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
