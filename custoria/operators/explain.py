"""What drives a tree model: impurity importances and additive attributions per row."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import astuple, dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from custoria.operators.boosting import BoostedTrees, Tree
from custoria.session import scratch_path

#: Features on a path up to which all patterns of known and unknown ones are tabulated per leaf.
TABLED = 10
#: Leaves whose contributions are held at once, times rows of a batch.
_AT_ONCE = 1 << 18


def importances(spark: SparkSession, model, names: list[str] | DataFrame) -> DataFrame:
    """One row per matrix column with the model's impurity importance.

    The names of a wide matrix are a table (place, feature), with which the columns a model uses at all are joined.
    """
    if isinstance(names, DataFrame):
        values = model.featureImportances.toArray()
        rows = [(int(i), float(values[i])) for i in np.flatnonzero(values)]
        split_on = spark.createDataFrame(rows, "place bigint, importance double")
        joined = names.join(F.broadcast(split_on), "place", "left")  # no more than the model has nodes
        return joined.select("feature", F.coalesce("importance", F.lit(0.0)).alias("importance"))
    values = model.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(names, values)), "feature string, importance double")


@dataclass(frozen=True)
class Leaf:
    """A leaf with its tree-weighted value and, per feature on its path, the interval that leads
    to it and the share of training weight that follows it."""

    value: float
    features: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    share: tuple[float, ...]


def tree_leaves(spark: SparkSession, model) -> list[Leaf]:
    """All leaves of a boosted or averaged tree model; those of Spark ML are read from the saved node table.

    Their number is bounded by trees x 2^depth, whatever the number of rows. What a boosted model starts from is a leaf too.
    """
    if isinstance(model, BoostedTrees):
        start = Leaf(model.base, (), (), (), ())
        return [start, *(leaf for tree in model.trees for leaf in _leaves(_nodes(tree), 1.0))]
    path = scratch_path(spark, "trees")
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        F.col("nodeData.id").alias("id"),
        F.col("nodeData.prediction").alias("value"),
        F.get("nodeData.impurityStats", F.lit(0)).alias("cover"),
        F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
    )
    trees: dict[int, dict[int, dict]] = defaultdict(dict)
    for node in nodes.collect():  # bounded by trees x 2^(depth + 1)
        trees[node["tree"]][node["id"]] = node.asDict()
    weights = model.treeWeights
    return [leaf for tree, table in sorted(trees.items()) for leaf in _leaves(table, weights[tree])]


def _nodes(tree: Tree) -> dict[int, dict]:
    return {
        node: {"left": 2 * node + 1 if feature >= 0 else -1, "right": 2 * node + 2, "feature": feature, "threshold": cut, "value": value, "cover": cover}
        for node, feature, _, cut, value, cover, _ in tree.rows()
    }


def _leaves(nodes: dict[int, dict], weight: float) -> list[Leaf]:
    found: list[Leaf] = []
    start: dict[int, tuple[float, float, float]] = {}
    open_nodes = [(0, start)]
    while open_nodes:
        at, path = open_nodes.pop()
        node = nodes[at]
        if node["left"] < 0:
            order = sorted(path)
            found.append(
                Leaf(
                    weight * node["value"],
                    tuple(order),
                    tuple(path[f][0] for f in order),
                    tuple(path[f][1] for f in order),
                    tuple(path[f][2] for f in order),
                )
            )
            continue
        feature, cut = node["feature"], node["threshold"]
        low, high, share = path.get(feature, (-np.inf, np.inf, 1.0))
        for child, span in ((node["left"], (low, min(high, cut))), (node["right"], (max(low, cut), high))):
            part = nodes[child]["cover"] / node["cover"]
            open_nodes.append((child, {**path, feature: (*span, share * part)}))
    return found


def base_value(leaves: list[Leaf]) -> float:
    """The model's average output over the training weight: what all attributions start from."""
    return float(sum(leaf.value * np.prod(leaf.share) for leaf in leaves))


def _shares(share: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Shapley shares of the features on a path, by the feature: `share` (..., k) and `known` (..., k) of 0 and 1.

    Within one leaf a coalition's value is a product over its path features: 1 or 0 for a known feature, the training share
    for an unknown one. The Shapley sum over coalitions therefore needs only the coefficients, by coalition size, of the
    product of (share + known * t): the path of all features is extended one by one, and each is unwound from it in turn.
    """
    depth = share.shape[-1]
    out = np.zeros(np.broadcast_shapes(share.shape, known.shape))
    sizes = np.array([factorial(s) * factorial(depth - s - 1) / factorial(depth) for s in range(depth)])
    for i in range(depth):
        by_size = np.zeros((*out.shape[:-1], depth))
        by_size[..., 0] = 1.0
        for j in range(depth):
            if j != i:
                grown = by_size * share[..., j : j + 1]
                grown[..., 1:] += by_size[..., :-1] * known[..., j : j + 1]
                by_size = grown
        out[..., i] = (known[..., i] - share[..., i]) * (by_size @ sizes)
    return out


class Explainer:
    """Attributions against a list of leaves.

    What a leaf adds to its features depends on which of them lead a row to it, and on nothing else: that table of 2^k
    patterns is computed once a leaf, and a row is k comparisons and one look-up.
    """

    def __init__(self, leaves: list[Leaf]):
        by_depth: dict[int, list[Leaf]] = defaultdict(list)
        for leaf in leaves:
            by_depth[len(leaf.features)].append(leaf)
        self.groups = []
        for depth, own in sorted(by_depth.items()):
            if not depth:
                continue
            features, low, high, share = (np.array([getattr(leaf, k) for leaf in own]) for k in ("features", "low", "high", "share"))
            value = np.array([leaf.value for leaf in own])
            table = None
            if depth <= TABLED:
                patterns = (np.arange(1 << depth)[:, None] >> np.arange(depth) & 1).astype(float)
                table = value[:, None, None] * _shares(share[:, None, :], patterns[None])
            self.groups.append((features, low, high, share, value, table))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        phi = np.zeros(x.shape)
        for features, low, high, share, value, table in self.groups:
            step = max(1, _AT_ONCE // max(1, len(x)))
            for at in range(0, len(features), step):
                part = slice(at, at + step)
                own = features[part]
                known = (x[:, own] > low[part]) & (x[:, own] <= high[part])
                if table is not None:
                    code = known @ (1 << np.arange(own.shape[1]))
                    adds = table[part][np.arange(len(own)), code]
                else:
                    adds = value[part][:, None] * _shares(share[part], known.astype(float))
                flat, order = own.ravel(), np.argsort(own.ravel(), kind="stable")
                first = np.flatnonzero(np.diff(flat[order], prepend=-1))
                phi[:, flat[order][first]] += np.add.reduceat(adds.reshape(len(x), -1)[:, order], first, axis=1)
        return phi


def attribute(x: np.ndarray, leaves: list[Leaf]) -> np.ndarray:
    """Shapley attributions of the margin for the rows of `x`, conditioned on the tree paths."""
    return Explainer(leaves)(x)


def attributions(table: DataFrame, model, names: list[str], keys: list[str]) -> DataFrame:
    """Add one attribution per matrix column, as the array `phi`, to every row.

    Rows stay where they are: each Arrow batch is explained against the leaf list, which is
    shipped once as a broadcast variable. The margin is sum(phi) + base.
    """
    spark = table.sparkSession
    leaves = tree_leaves(spark, model)
    # Plain tuples: broadcast values are unpickled where this package need not be installed.
    shared = spark.sparkContext.broadcast([astuple(leaf) for leaf in leaves])

    def explain(batches):
        explainer = Explainer([Leaf(*parts) for parts in shared.value])
        for batch in batches:
            matrix = np.array(batch["x"].tolist(), dtype=float).reshape(len(batch), -1)
            out = batch[keys].copy()
            out["phi"] = list(explainer(matrix))
            yield out

    kept = ", ".join(f"`{k}` {dict(table.dtypes)[k]}" for k in keys)
    rows = table.select(*keys, vector_to_array("features").alias("x"))
    return rows.mapInPandas(explain, f"{kept}, phi array<double>").withColumn("base", F.lit(base_value(leaves)))


def ranked_attributions(explained: DataFrame, names: list[str]) -> DataFrame:
    """Mean absolute attribution per matrix column: one pass, one output row per column."""
    means = explained.agg(*[F.avg(F.abs(F.col("phi")[i])).alias(f"a{i}") for i in range(len(names))])
    return means.unpivot([], means.columns, "slot", "mean_abs").join(
        F.broadcast(
            explained.sparkSession.createDataFrame(
                [(f"a{i}", name) for i, name in enumerate(names)], "slot string, feature string"
            )
        ),
        "slot",
    ).select("feature", "mean_abs")
