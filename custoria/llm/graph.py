"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custoria.llm.common import settle


def _signature(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of `edges` (u, v): the label is the smallest node of its component.

    Alternating large-star and small-star steps; each hangs neighbours onto the smallest one around and combines before
    it shuffles. Edges are written to the shared folder first, as they are read twice, and after every round. Self loops give
    a node of its own.
    """
    edges = settle(edges.select("u", "v"), "edges")
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    edges = settle(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    nodes = settle(nodes, "nodes")
    now = _signature(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        parent = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(parent, "u")
        small = hung.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = settle(small.unionByName(parent.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, now = now, _signature(edges)
        if now == before:
            break
    return nodes.join(edges.withColumnRenamed("u", "node"), "node", "left").select(
        "node", F.coalesce("v", "node").alias("label")
    )
