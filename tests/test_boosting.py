"""Boosted trees against a plain fit, across partitionings, and through an interruption."""

import math
import pickle
import random

import numpy as np
import pytest
from pyspark import RDD
from pyspark.ml.linalg import Vectors

from custoria.operators import boosting, learners
from custoria.operators.boosting import LOGISTIC, SQUARED, Settings
from custoria.operators.evaluation import roc_auc
from custoria.sources import files


def plain_fit(x, y, w, settings):
    """Margins of the same boosting, one value and node at a time, over all cuts between distinct values.

    Rows of weight 0 are carried along, and so scored without being learned from."""
    def slope(f):
        if settings.loss == LOGISTIC:
            p = 1 / (1 + np.exp(-f))
            return w * (p - y), w * p * (1 - p)
        return w * (f - y), w.copy()

    mean = (w * y).sum() / w.sum()
    f = np.full(len(y), np.float32(np.log(mean / (1 - mean)) if settings.loss == LOGISTIC else mean), float)
    for _ in range(settings.rounds):
        g, h = slope(f)
        step = np.zeros(len(y))

        def split(rows, depth):
            whole = g[rows].sum() ** 2 / (h[rows].sum() + settings.penalty)
            best = (settings.least_gain, None)
            own = rows[w[rows] > 0]
            for column in range(x.shape[1] if depth else 0):
                values = np.unique(x[own, column])
                for cut in (values[:-1] + values[1:]) / 2:
                    sides = own[x[own, column] <= cut], own[x[own, column] > cut]
                    if min(h[side].sum() for side in sides) < settings.least_child:
                        continue
                    gain = sum(g[s].sum() ** 2 / (h[s].sum() + settings.penalty) for s in sides) - whole
                    if gain > best[0] + 1e-9:
                        best = (gain, (rows[x[rows, column] <= cut], rows[x[rows, column] > cut]))
            if best[1] is None:
                step[rows] = -g[rows].sum() / (h[rows].sum() + settings.penalty)
            else:
                for side in best[1]:
                    split(side, depth - 1)

        split(np.arange(len(y)), settings.depth)
        f = f + settings.rate * step
    return f


def sample(rng, n, values):
    x = np.array([[rng.randrange(values), rng.randrange(values), rng.random() < 0.02, rng.randrange(3)] for _ in range(n)], float)
    if values > 1000:
        x[:, :2] /= values
    drive = 3 * x[:, 0] / max(x[:, 0].max(), 1) + 2 * x[:, 2] - (x[:, 1] / max(x[:, 1].max(), 1) > 0.4) - 1
    y = np.array([float(rng.random() < 1 / (1 + math.exp(-d))) for d in drive])
    w = np.array([rng.choice([1.0, 0.5, 2.25]) for _ in range(n)])
    return x, y, w


def table_of(spark, x, y, w, parts=1):
    rows = [(Vectors.dense(a), float(b), float(c)) for a, b, c in zip(x, y, w)]
    return spark.createDataFrame(rows, ["features", "y", "w"]).repartition(parts)


def margins(model, x):
    return model.margin(np.ascontiguousarray(x.T))


@pytest.mark.parametrize("loss, penalty", [(LOGISTIC, 1.0), (SQUARED, 0.0)])
def test_equals_a_plain_fit(spark, loss, penalty):
    x, y, w = sample(random.Random(5), 400, 12)
    if loss == SQUARED:
        y = 100 * y + 7 * x[:, 0] - 3 * x[:, 1]
    settings = Settings(loss, 6, 3, 0.3, penalty=penalty, save_every=4)
    model = boosting.boost(table_of(spark, x, y, w), "y", "w", settings)
    wanted = plain_fit(x, y, w, settings)
    assert margins(model, x) == pytest.approx(wanted, abs=1e-6 * max(1, abs(wanted).max()))
    assert all(b < a for a, b in zip(model.losses, model.losses[1:])) and len(model.losses) == 7
    # a cover is the Hessian that reaches a node
    for tree in model.trees:
        for node in np.flatnonzero(tree.feature >= 0):
            assert tree.cover[node] == pytest.approx(tree.cover[2 * node + 1] + tree.cover[2 * node + 2])


def test_ranks_like_a_fit_over_all_cuts(spark):
    """More distinct values than bins: on 20,000 fresh rows the area under the curve is that of the plain fit within 0.002."""
    x, y, w = sample(random.Random(6), 21_500, 10**6)
    settings = Settings(LOGISTIC, 25, 3, 0.1)
    known = np.arange(len(y)) < 1500
    model = boosting.boost(table_of(spark, x[known], y[known], w[known]), "y", "w", settings)
    found, wanted, y = margins(model, x)[~known], plain_fit(x, y, w * known, settings)[~known], y[~known]
    rows = [("found", int(t), float(s)) for t, s in zip(y, found)] + [("wanted", int(t), float(s)) for t, s in zip(y, wanted)]
    auc = {r["model"]: r["roc_auc"] for r in roc_auc(spark.createDataFrame(rows, "model string, label int, prob double")).collect()}
    assert auc["wanted"] > 0.7 and abs(auc["found"] - auc["wanted"]) < 0.002


def same(a, b):
    return all(np.array_equal(getattr(s, k), getattr(t, k)) for s, t in zip(a.trees, b.trees, strict=True) for k in vars(s))


@pytest.mark.parametrize("driver_parts", [32, 2])
def test_one_partition_or_many_give_the_same_trees(spark, monkeypatch, driver_parts):
    x, y, w = sample(random.Random(7), 900, 40)
    settings = Settings(LOGISTIC, 7, 4, 0.2, save_every=3)
    once = boosting.boost(table_of(spark, x, y, w), "y", "w", settings)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 100)
    monkeypatch.setattr(boosting, "DRIVER_PARTS", driver_parts)
    fit = boosting.Fit(table_of(spark, x, y, w, 6), "y", "w", settings, None)
    assert fit.n_parts > 2
    spread = fit.train()
    assert same(once, spread) and spread.losses == pytest.approx(once.losses, abs=1e-12)


def test_the_driver_gets_splits_not_sums(spark, monkeypatch):
    x, y, w = sample(random.Random(11), 900, 200)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 100)
    fit = boosting.Fit(table_of(spark, x, y, w, 6), "y", "w", Settings(LOGISTIC, 2, 3, 0.2), None)
    assert fit.n_parts > 2 and sum(fit.bins.sizes) > 300
    sizes, collect = [], RDD.collect

    def weighed(rdd):
        found = collect(rdd)
        sizes.append(len(pickle.dumps(found)))
        return found

    monkeypatch.setattr(RDD, "collect", weighed)
    fit._grow(2)
    assert len(fit.model.trees) == 2 and all(t.feature[0] >= 0 for t in fit.model.trees)
    # a dozen numbers per node and slice, whatever the number of bins and partitions
    assert sizes and max(sizes) < 6_000


def test_goes_on_after_an_interruption(spark, tmp_path, monkeypatch):
    x, y, w = sample(random.Random(8), 600, 30)
    table = table_of(spark, x, y, w)
    settings = Settings(LOGISTIC, 25, 3, 0.2, save_every=5)
    whole = boosting.boost(table, "y", "w", settings)

    class Lost(Exception):
        pass

    def lose(rounds):
        if rounds == 20:
            raise Lost

    folder = str(tmp_path / "saved")
    with pytest.raises(Lost):
        boosting.Fit(table, "y", "w", settings, folder).train(lose)
    # a write that never finished is passed over
    name = next(n for n in files.names(spark, folder))
    (tmp_path / "saved" / name / "blocks-00025").mkdir()
    grown = []
    monkeypatch.setattr(boosting.Fit, "_grow", lambda self, n, kept=boosting.Fit._grow: (grown.append(n), kept(self, n))[1])
    fit = boosting.Fit(table, "y", "w", settings, folder)
    assert len(fit.model.trees) == 20
    again = fit.train()
    assert grown == [5] and same(whole, again) and again.losses == pytest.approx(whole.losses, abs=1e-12)
    # other rows or settings do not take up what is not theirs; more rounds lengthen the run
    assert not boosting.Fit(table.limit(500), "y", "w", settings, folder).model.trees
    longer = boosting.Fit(table, "y", "w", Settings(LOGISTIC, 30, 3, 0.2, save_every=5), folder)
    assert len(longer.model.trees) == 25 and len(longer.train().trees) == 30


def test_degenerate_tables(spark):
    x, y, w = sample(random.Random(9), 50, 5)
    with pytest.raises(ValueError):
        boosting.boost(table_of(spark, x, y, w).limit(0), "y", "w", Settings(LOGISTIC, 2, 3, 0.1))
    constant = boosting.boost(table_of(spark, np.ones_like(x), y, w), "y", "w", Settings(LOGISTIC, 2, 3, 0.1))
    assert not constant.featureImportances.toArray().any() and len(set(margins(constant, x))) == 1
    one = learners.boosted_classifier(table_of(spark, x, np.ones(50), w), "y", "w", rounds=3)
    assert np.isfinite(margins(one, x)).all()
    nulls = spark.createDataFrame([(Vectors.dense(a), None if i % 2 else float(b)) for i, (a, b) in enumerate(zip(x, y))], ["features", "y"])
    half = learners.boosted_regressor(nulls, "y", rounds=3)
    assert margins(half, x) == pytest.approx(margins(learners.boosted_regressor(table_of(spark, x[::2], y[::2], w[::2]), "y", rounds=3), x))


def test_bins_are_bounded_and_exact_for_few_values(spark):
    x = np.array([[i % 7, i, i == 3] for i in range(2000)], float)
    cuts = boosting.find_cuts(table_of(spark, x, x[:, 0], x[:, 0] + 1), 3)
    assert cuts[0] == [0.5, 1.5, 2.5, 3.5, 4.5, 5.5] and cuts[2] == [0.5]
    assert 200 < len(cuts[1]) < 256
    with pytest.raises(ValueError):
        boosting.find_cuts(table_of(spark, x, x[:, 0], x[:, 0]), 3, bins=300)
