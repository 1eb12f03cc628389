"""Second-order boosted trees on distributed gradient histograms.

Rows are binned once and kept as blocks of columns, a byte a value. A tree grows level by level: one job adds up, per open
node, feature and bin, the gradients and Hessians of all rows; of two siblings only the lighter one is added up, the other
is its parent less that. The sums are shuffled by slices of features, and the task of a slice picks each node's split of the
greatest gain in it. The driver sees a split per node and slice alone; a leaf is -G / (H + penalty). Gradients are rounded to a fixed grid before they
are added, so sums do not depend on the order of rows, blocks or tasks, and with the same cuts neither does the model. Where one partition
holds every row, the same steps run inside its task, as there is nothing to add up across tasks.

Every `save_every` rounds the trees and the rows' margins are saved. Tasks need nothing but a saved block and the trees
since, so a lost executor costs one read, and a lost driver goes on from the last save when given the same folder again.
"""

from __future__ import annotations

import hashlib
import json
import sys
import types
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custoria.functions.columns import as_double
from custoria.session import scratch_path
from custoria.sources import files

#: Rows of a block, and blocks whose margins a Python worker remembers between jobs.
BLOCK_ROWS, REMEMBERED = 65_536, 64
#: Most slices of features, whose tasks each tell the driver one split per node.
DRIVER_PARTS = 32
MOST_BINS = 256
LOGISTIC, SQUARED = "logistic", "squared"

_BLOCK = "block bigint, n bigint, codes binary, label binary, weight binary, margin binary"


@dataclass(frozen=True)
class Settings:
    loss: str
    rounds: int
    depth: int
    rate: float
    #: Added to the Hessians of a leaf; least Hessian of a child; least gain of a split.
    penalty: float = 1.0
    least_child: float = 1.0
    least_gain: float = 1e-6
    bins: int = MOST_BINS
    save_every: int = 50


@dataclass
class Tree:
    """A tree as arrays in heap order: the children of node i are 2i + 1 and 2i + 2. A leaf has feature -1."""

    feature: np.ndarray
    code: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = (1 << (depth + 1)) - 1
        return Tree(np.full(n, -1, "i4"), np.zeros(n, "i4"), *(np.zeros(n) for _ in range(4)))

    @property
    def depth(self) -> int:
        return (len(self.feature) + 1).bit_length() - 2

    def leaf_of(self, columns: np.ndarray, border: np.ndarray) -> np.ndarray:
        """The node each row ends in; `columns` holds a row per feature, compared with `border` of the node."""
        rows = np.arange(columns.shape[1])
        node = np.zeros(len(rows), "i8")
        for _ in range(self.depth):
            feature = self.feature[node]
            inner = feature >= 0
            if not inner.any():
                break
            right = columns[feature, rows] > border[node]
            node = np.where(inner, 2 * node + 1 + right, node)
        return node


    def rows(self) -> list[tuple]:
        """(node, feature, code, cut, value, cover, gain) of the nodes in use."""
        used = np.zeros(len(self.feature), bool)
        used[0] = True
        for node in np.flatnonzero(self.feature >= 0):  # heap order: parents first
            used[2 * node + 1 : 2 * node + 3] = True
        arrays = (self.feature, self.code, self.cut, self.value, self.cover, self.gain)
        return [(i, *(a[i].item() for a in arrays)) for i in np.flatnonzero(used).tolist()]


@dataclass
class BoostedTrees:
    """A fitted ensemble. The margin of a row is `base` plus the values of the leaves it ends in."""

    loss: str
    base: float
    features: int
    trees: list[Tree] = field(default_factory=list)
    #: Weighted mean loss of the training rows before the first and after every tree.
    losses: list[float] = field(default_factory=list)

    @property
    def featureImportances(self) -> DenseVector:
        """Gain per feature over all splits, summing to 1, as Spark's tree models report theirs."""
        total = np.zeros(self.features)
        for tree in self.trees:
            inner = tree.feature >= 0
            np.add.at(total, tree.feature[inner], tree.gain[inner])
        return Vectors.dense(total / (total.sum() or 1.0))

    def margin(self, columns: np.ndarray) -> np.ndarray:
        out = np.full(columns.shape[1], self.base)
        for tree in self.trees:
            out += tree.value[tree.leaf_of(columns, tree.cut)]
        return out

    def margin_of(self, features: str = "features") -> Column:
        trees = [(t.feature, t.cut, t.value) for t in self.trees]
        base = self.base

        @F.pandas_udf("double")
        def margins(x: pd.Series) -> pd.Series:
            columns = np.ascontiguousarray(np.stack(x.to_numpy()).T) if len(x) else np.zeros((1, 0))
            empty = np.zeros(0)
            model = BoostedTrees("", base, 0, [Tree(f, f, c, v, empty, empty) for f, c, v in trees])
            return pd.Series(model.margin(columns))

        return margins(vector_to_array(features))

    def score(self, features: str = "features") -> Column:
        """The probability of class 1 under the logistic loss, else the predicted value."""
        margin = self.margin_of(features)
        return 1 / (1 + F.exp(-margin)) if self.loss == LOGISTIC else margin


def _gradient(loss: str, label: np.ndarray, weight: np.ndarray, margin: np.ndarray):
    """(gradient, Hessian, loss) of every row, times its weight."""
    if loss == LOGISTIC:
        p = 1 / (1 + np.exp(-margin))
        cost = np.logaddexp(0, margin) - label * margin
        return weight * (p - label), weight * p * (1 - p), weight * cost
    error = margin - label
    return weight * error, weight, weight * error * error / 2


# ---- binning ------------------------------------------------------------------------------------


def find_cuts(train: DataFrame, features: int, bins: int = MOST_BINS) -> list[list[float]]:
    """Ascending cuts per feature; a value is in bin k when k cuts are below it.

    A feature of at most `bins` distinct values is cut between all of them, exactly; others at as many approximate
    quantiles, which differ a little with the partitioning.
    Distinct values that reach the driver are bounded by features x bins.
    """
    if not 2 <= bins <= MOST_BINS:
        raise ValueError(f"bins are at most {MOST_BINS}, as a bin is stored in a byte")
    cells = train.select(F.posexplode(vector_to_array("features")).alias("feature", "value")).filter(~F.isnan("value"))
    shares = [k / bins for k in range(1, bins)]
    spread = cells.groupBy("feature").agg(
        F.approx_count_distinct("value", 0.02).alias("distinct"), F.percentile_approx("value", shares, 10_000).alias("cuts")
    )
    spread = {r["feature"]: r for r in spread.collect()}
    few = [f for f, r in spread.items() if r["distinct"] <= 1.2 * bins]
    values: dict[int, list[float]] = {f: [] for f in few}
    if few:
        for r in cells.filter(F.col("feature").isin(few)).distinct().collect():
            values[r["feature"]].append(r["value"])
    cuts: list[list[float]] = []
    for f in range(features):
        own = sorted(values.get(f, ()))
        if f in spread and (not own or len(own) > bins):
            cuts.append(sorted(set(spread[f]["cuts"])))
        else:
            cuts.append([(a + b) / 2 for a, b in zip(own, own[1:])])
    return cuts


def _encode(cuts: list[list[float]], base: float):
    borders = [np.array(c) for c in cuts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def block() -> pa.RecordBatch:
            nonlocal held, size, made
            label, weight = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            codes = np.concatenate([h[2] for h in held], axis=1)
            columns = [[(part << 32) + made], [size], [codes.tobytes()], [label.tobytes()], [weight.tobytes()]]
            columns.append([np.full(size, base).tobytes()])
            kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 4)
            held, size, made = [], 0, made + 1
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["block", "n", "codes", "label", "weight", "margin"])

        for batch in batches:
            if not batch.num_rows:
                continue
            label, weight = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            codes = np.empty((len(borders), batch.num_rows), "u1")
            for f, border in enumerate(borders):
                codes[f] = np.searchsorted(border, x[:, f], "left")
            held.append((label, weight, codes))
            size += batch.num_rows
            if size >= BLOCK_ROWS:
                yield block()
        if held:
            yield block()

    return run


# ---- jobs over the blocks -----------------------------------------------------------------------


def _kept() -> dict:
    """Margins that this Python worker has computed, by run and block: only ever saves time."""
    return sys.modules.setdefault("_custoria_margins", types.ModuleType("_custoria_margins")).__dict__


def _margin(run: str, block: int, start: np.ndarray, codes: np.ndarray, trees: list[Tree], first: int) -> np.ndarray:
    """The saved margin, which the first trees made, and all `trees` since."""
    kept, key = _kept(), (run, block)
    done, margin = kept.get(key, (-1, start))
    if not first <= done <= first + len(trees):
        done, margin = first, start
    for tree in trees[done - first :]:
        margin = margin + tree.value[tree.leaf_of(codes, tree.code)]
    if len(kept) >= REMEMBERED and key not in kept:
        kept.clear()
    kept[key] = (first + len(trees), margin)
    return margin


@dataclass(frozen=True)
class Bins:
    """Number of bins per feature; the bins of all features lie side by side."""

    sizes: list[int]

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.sizes)]).astype(int)

    def slices(self, most: int) -> list[tuple[int, int]]:
        """At most `most` ranges of features with about as many bins each."""
        starts = self.starts
        ends = np.unique(np.searchsorted(starts, np.linspace(0, starts[-1], most + 1))).tolist()
        return list(zip(ends, ends[1:]))


@dataclass(frozen=True)
class Level:
    """The open nodes of a level, ascending, and those of them whose rows are added up: of two siblings the lighter one."""

    nodes: list[int]
    light: list[int]
    #: Places of the parents in the level above, and of the open nodes among the light ones and then their siblings.
    split: list[int] = field(default_factory=list)
    order: list[int] = field(default_factory=list)

    def below(self, tree: Tree, split: list[int]) -> Level:
        parents = [self.nodes[at] for at in split]
        light = [2 * p + 1 if tree.cover[2 * p + 1] <= tree.cover[2 * p + 2] else 2 * p + 2 for p in parents]
        both = [*light, *(4 * p + 3 - child for p, child in zip(parents, light))]
        order = np.argsort(both).tolist()
        return Level([both[i] for i in order], light, split, order)

    def sums(self, own: np.ndarray, above: np.ndarray | None) -> np.ndarray:
        """Sums of all open nodes, from those of the light ones and of the level above."""
        if above is None:
            return own
        return np.concatenate([own, above[:, self.split] - own], 1)[:, self.order]


ROOT = Level([0], [0])


def _add_up(blocks, run: str, loss: str, bins: Bins, trees: list[Tree], first: int, grown: Tree | None, nodes: list[int], grid: float):
    """(gradient and Hessian sums per node and bin, loss) of the rows of some blocks, in units of the grid."""
    starts = bins.starts
    total, lost = np.zeros((2, len(nodes), starts[-1])), 0.0
    for block, n, codes, label, weight, margin in blocks:
        columns = np.frombuffer(codes, "u1").reshape(len(bins.sizes), n)
        y, w = np.frombuffer(label), np.frombuffer(weight)
        f = _margin(run, block, np.frombuffer(margin), columns, trees, first)
        g, h, cost = _gradient(loss, y, w, f)
        lost += float(cost.sum())
        g, h = np.rint(g * grid), np.rint(h * grid)
        slot = np.zeros(n, "i8")
        if grown is not None:
            place = np.full(len(grown.feature), -1)
            place[nodes] = np.arange(len(nodes))
            slot = place[grown.leaf_of(columns, grown.code)]
            here = np.flatnonzero(slot >= 0)
            columns, g, h, slot = columns[:, here], g[here], h[here], slot[here]
        for at, size in enumerate(bins.sizes):
            cell = slot * size + columns[at]
            for k, v in enumerate((g, h)):
                total[k, :, starts[at] : starts[at + 1]] += np.bincount(cell, v, len(nodes) * size).reshape(len(nodes), size)
    return total, lost


def _advance(settings: Settings, features: int, trees: list[Tree]):
    """Blocks with their margins brought up to date by `trees`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = []
            for row in batch.select(["n", "codes", "margin"]).to_pylist():
                columns = np.frombuffer(row["codes"], "u1").reshape(features, row["n"])
                margin = np.frombuffer(row["margin"])
                for tree in trees:
                    margin = margin + tree.value[tree.leaf_of(columns, tree.code)]
                margins.append(margin.tobytes())
            at = batch.schema.get_field_index("margin")
            yield batch.set_column(at, "margin", pa.array(margins, pa.binary()))

    return run


# ---- growing ------------------------------------------------------------------------------------


def _best(sums: np.ndarray, starts: np.ndarray, settings: Settings):
    """(gain, feature, bin, left G, left H, G, H) per node and its best split; a gain of -inf where there is none.

    Ties go to the first feature and bin.
    """
    g, h = sums
    whole_g, whole_h = (s[:, : starts[1]].sum(1)[:, None] for s in (g, h))
    left = []
    for s in (g, h):
        run = np.cumsum(s, 1)
        before = np.concatenate([np.zeros((len(s), 1)), run], 1)[:, starts[:-1]]
        left.append(run - np.repeat(before, np.diff(starts), 1))
    left_g, left_h = left
    right_g, right_h = whole_g - left_g, whole_h - left_h
    fits = (left_h >= settings.least_child) & (right_h >= settings.least_child)
    fits[:, starts[1:] - 1] = False  # nothing lies right of a feature's last bin
    with np.errstate(divide="ignore", invalid="ignore"):
        parent = whole_g**2 / (whole_h + settings.penalty)
        gain = left_g**2 / (left_h + settings.penalty) + right_g**2 / (right_h + settings.penalty) - parent
    gain = np.where(fits & (gain > settings.least_gain), gain, -np.inf)
    cell = np.argmax(gain, 1)
    rows = np.arange(len(cell))
    feature = np.searchsorted(starts, cell, "right") - 1
    return gain[rows, cell], feature, cell - starts[feature], left_g[rows, cell], left_h[rows, cell], whole_g[:, 0], whole_h[:, 0]


def grow(level: Callable, cuts: list[list[float]], settings: Settings) -> tuple[Tree, float]:
    """One more tree and the loss before it. `level(tree, at)` finds the best splits of the open nodes of a tree so far."""
    tree, at = Tree.empty(settings.depth), ROOT
    found, lost = level(None, at)
    for depth in range(settings.depth):
        gain, feature, code, left_g, left_h, g, h = found
        if not depth:
            tree.value[0], tree.cover[0] = (-g[0] / (h[0] + settings.penalty) if h[0] + settings.penalty > 0 else 0.0), h[0]
        split = [i for i in range(len(at.nodes)) if gain[i] > -np.inf]
        for i in split:
            node = at.nodes[i]
            tree.feature[node], tree.code[node], tree.gain[node] = feature[i], code[i], gain[i]
            tree.cut[node] = cuts[feature[i]][code[i]]
            sides = ((left_g[i], left_h[i]), (g[i] - left_g[i], h[i] - left_h[i]))
            for child, (own_g, own_h) in zip((2 * node + 1, 2 * node + 2), sides):
                tree.value[child], tree.cover[child] = -own_g / (own_h + settings.penalty), own_h
        if not split or depth + 1 == settings.depth:
            break
        at = at.below(tree, split)
        found, _ = level(tree, at)
    tree.value *= settings.rate
    return tree, lost


def _grow_here(run: str, settings: Settings, cuts: list[list[float]], bins: Bins, first: int, rounds: int, grid: float):
    """Task side where one partition holds every row: `rounds` trees, grown as the driver grows them."""

    def one(blocks):
        blocks, trees, losses, sums = list(blocks), [], [], None

        def level(grown, at):
            nonlocal sums
            total, lost = _add_up(blocks, run, settings.loss, bins, trees, first, grown, at.light, grid)
            sums = at.sums(total, None if grown is None else sums)
            return _best(sums / grid, bins.starts, settings), lost

        for _ in range(rounds):
            tree, lost = grow(level, cuts, settings)
            trees.append(tree)
            losses.append(lost)
        yield trees, losses

    return one


def _by_slice(known: tuple, bins: Bins, slices: list[tuple[int, int]], depth: int):
    """Task side: the sums of a partition by slice of features. One without blocks has none."""
    starts = bins.starts

    def run(part: int, blocks):
        for block in blocks:
            total, lost = _add_up(chain([block], blocks), *known)
            for own, (a, b) in enumerate(slices):
                yield own, (depth, part, lost, total[:, :, starts[a] : starts[b]])

    return run


def _choose(levels: list[Level], settings: Settings, bins: Bins, slices: list[tuple[int, int]], grid: float):
    """Task side: (slice, best splits in it of the last level's open nodes, loss) from the sums of all levels so far."""

    def run(rows):
        totals, costs, own = [0.0] * len(levels), {}, None
        for own, (depth, part, lost, total) in rows:
            totals[depth] = totals[depth] + total
            if depth + 1 == len(levels):
                costs[part] = lost
        if own is None:
            return
        sums = None
        for level, total in zip(levels, totals):
            sums = level.sums(total, sums)
        a, b = slices[own]
        gain, feature, *others = _best(sums / grid, bins.starts[a : b + 1] - bins.starts[a], settings)
        yield own, (gain, feature + a, *others), sum(costs[part] for part in sorted(costs))

    return run


class Fit:
    """One run of boosting: the blocks, what is saved, and the trees so far."""

    def __init__(self, train: DataFrame, label: str, weight: str | None, settings: Settings, folder: str | None):
        self.spark: SparkSession = train.sparkSession
        self.settings = settings
        x = vector_to_array("features")
        w = as_double(weight) if weight else F.lit(1.0)
        rows = train.select(as_double(label).alias("y"), w.alias("w"), x.alias("x"), "features").filter("y IS NOT NULL AND w IS NOT NULL")
        mark = F.xxhash64("y", "w", "x")
        known = rows.agg(
            F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"), F.max(F.size("x")).alias("features"),
            F.sum(F.col("w") * F.col("y") * F.col("y")).alias("wyy"), F.bit_xor(mark).alias("xor"), F.sum(F.pmod(mark, F.lit(1 << 31))).alias("sum"),
        ).first()
        if not known["n"] or not known["w"]:
            raise ValueError("boosting needs a row with a label and a positive weight")
        self.features, self.weight = known["features"], known["w"]
        mean = known["wy"] / known["w"]
        if settings.loss == LOGISTIC:
            mean = min(max(mean, 1e-6), 1 - 1e-6)
            base, size = np.log(mean / (1 - mean)), known["w"]
        else:
            spread = max(known["wyy"] / known["w"] - mean * mean, 0.0)
            base, size = mean, known["w"] * max(spread**0.5, 1.0)
        self.base = float(np.float32(base))  # the same whatever the order of the sums above
        #: Sums of this many times a gradient are whole numbers that a double holds exactly.
        self.grid = 2.0 ** np.floor(51 - np.log2(size * max(1, self.features)))
        told = json.dumps([{k: v for k, v in asdict(settings).items() if k != "rounds"}, *(str(known[k]) for k in ("n", "w", "wy", "xor", "sum"))])
        self.run = hashlib.sha256(told.encode()).hexdigest()[:16]
        self.folder = f"{folder.rstrip('/')}/boosting-{self.run}" if folder else scratch_path(self.spark, "boosting")
        self.run += self.folder[-12:]
        self.model = BoostedTrees(settings.loss, self.base, self.features)
        self._open(rows, known["n"])

    def _path(self, what: str, rounds: int) -> str:
        return f"{self.folder}/{what}-{rounds:05d}"

    def _open(self, rows: DataFrame, n: int) -> None:
        """Go on from the last save, or bin the rows and begin."""
        saved = [int(name[7:]) for name in files.names(self.spark, self.folder) if name.startswith("blocks-")]
        saved = [r for r in saved if r <= self.settings.rounds and files.committed(self.spark, self._path("blocks", r)) and files.committed(self.spark, self._path("trees", r))]
        if saved:
            self._load(max(saved))
        else:
            self.cuts = find_cuts(rows, self.features, self.settings.bins)
            few = rows.select("y", "w", "x").coalesce(max(1, -(-n // BLOCK_ROWS)))
            few.mapInArrow(_encode(self.cuts, self.base), _BLOCK).write.mode("overwrite").parquet(self._path("blocks", 0))
            self._save_trees(0)
        self._read(max(saved, default=0))

    def _load(self, rounds: int) -> None:
        lines = [json.loads(r["value"]) for r in self.spark.read.text(self._path("trees", rounds)).collect()]  # a line a tree
        head = next(line for line in lines if "cuts" in line)
        self.cuts, self.model.losses = head["cuts"], head["losses"]
        trees = {line["round"]: line["nodes"] for line in lines if "round" in line}
        for at in range(rounds):
            tree = Tree.empty(self.settings.depth)
            for node, *values in trees[at]:
                for array, value in zip((tree.feature, tree.code, tree.cut, tree.value, tree.cover, tree.gain), values):
                    array[node] = value
            self.model.trees.append(tree)

    def _save_trees(self, rounds: int) -> None:
        lines = [{"cuts": self.cuts, "losses": self.model.losses}]
        lines += [{"round": at, "nodes": tree.rows()} for at, tree in enumerate(self.model.trees)]
        table = self.spark.createDataFrame([(json.dumps(line),) for line in lines], "value string")
        table.coalesce(1).write.mode("overwrite").text(self._path("trees", rounds))

    def _read(self, rounds: int) -> None:
        """Keep the blocks of a save at hand; what executors lose is read again."""
        self.first = rounds
        self.blocks = self.spark.read.parquet(self._path("blocks", rounds))
        self.bins = Bins([len(c) + 1 for c in self.cuts])
        self.parts = self.blocks.rdd.map(tuple).persist()
        self.n_parts = self.parts.getNumPartitions()
        self.slices = self.bins.slices(min(DRIVER_PARTS, int(np.ceil(np.sqrt(self.n_parts)))))

    def _save(self) -> None:
        rounds, before = len(self.model.trees), self.first
        since = self.model.trees[before:]
        self.blocks.mapInArrow(_advance(self.settings, self.features, since), _BLOCK).write.mode("overwrite").parquet(self._path("blocks", rounds))
        self._save_trees(rounds)
        self.parts.unpersist()
        self._read(rounds)
        files.delete(self.spark, self._path("blocks", before))
        files.delete(self.spark, self._path("trees", before))

    def _level(self, grown: Tree | None, at: Level) -> tuple[tuple, float]:
        """Best splits of the open nodes and the loss so far.

        Sums are shuffled once a level and stay in slices of features; what the slices know of the levels above is read again
        from that tree's earlier shuffles. The driver gets a split per node and slice.
        """
        bare = np.zeros(0)
        since = [Tree(t.feature, t.code, bare, t.value, bare, bare) for t in self.model.trees[self.first :]]
        known = (self.run, self.settings.loss, self.bins, since, self.first, grown, at.light, self.grid)
        if grown is None:
            self.levels = []
        by_slice = _by_slice(known, self.bins, self.slices, len(self.levels))
        # All levels are dealt alike, so their union puts a slice's sums side by side and shuffles nothing again.
        self.levels.append((at, self.parts.mapPartitionsWithIndex(by_slice).partitionBy(len(self.slices), int)))
        sums = self.spark.sparkContext.union([table for _, table in self.levels])
        choose = _choose([level for level, _ in self.levels], self.settings, self.bins, self.slices, self.grid)
        found = sorted(sums.mapPartitions(choose).collect(), key=lambda f: f[0])
        best = np.argmax([splits[0] for _, splits, _ in found], 0)  # of equal gains the first feature's
        return tuple(np.array([found[i][1][k][n] for n, i in enumerate(best)]) for k in range(7)), found[0][2]

    def _grow(self, rounds: int) -> None:
        """More trees: level by level over all partitions, or within the only one."""
        if self.n_parts > 1:
            for _ in range(rounds):
                tree, lost = grow(self._level, self.cuts, self.settings)
                self.model.trees.append(tree)
                self.model.losses.append(lost / self.weight)
            return
        here = _grow_here(self.run, self.settings, self.cuts, self.bins, self.first, rounds, self.grid)
        trees, losses = self.parts.mapPartitions(here).collect()[0]
        self.model.trees += trees
        self.model.losses += [lost / self.weight for lost in losses]

    def train(self, after_save: Callable[[int], None] | None = None) -> BoostedTrees:
        while (left := self.settings.rounds - len(self.model.trees)) > 0:
            self._grow(min(left, self.settings.save_every - len(self.model.trees) % self.settings.save_every))
            self._save()
            if after_save:
                after_save(len(self.model.trees))
        if len(self.model.losses) == len(self.model.trees):
            self.model.losses.append(self._level(None, ROOT)[1] / self.weight)
        self.parts.unpersist()
        return self.model


def boost(train: DataFrame, label: str, weight: str | None, settings: Settings, folder: str | None = None) -> BoostedTrees:
    """Fit on the vector column `features` of `train`. Rows without label or weight are left out.

    With a `folder`, which must be shared and lasting, a run that was cut off goes on from its last save when it is called
    again with the same rows and settings; more `rounds` lengthen a finished run. The model is the same either way.
    """
    return Fit(train, label, weight, settings, folder).train()
