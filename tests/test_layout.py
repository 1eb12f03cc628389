"""Buckets of customers, dates from footers, slices and codes that grow with the data."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from custoria.operators import features, matrix, ordered
from custoria.operators.explain import importances
from custoria.operators.horizon import horizon, last_date, last_date_in_files, newest_in_files
from custoria.sources import layout, star
from custoria.sources.readers import Shop
from tests.conftest import SMALL
from tests.frames import customers, items, orders
from tests.test_scale import NO_BROADCAST, plan, settings


def table(shop, as_of=None):
    span = horizon(shop.orders, as_of=as_of or last_date(shop.orders))
    return features.churn_features(shop.customers, shop.orders, shop.order_items, span)


def rows(frame):
    return sorted(map(tuple, frame.select(sorted(frame.columns)).collect()), key=repr)


def test_features_over_buckets_need_no_exchange(spark, tmp_path):
    plain = star.shop(spark, SMALL)
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    with settings(spark, {**NO_BROADCAST, "spark.sql.requireAllClusterKeysForCoPartition": before}):
        saved = layout.write_layout(plain, f"{tmp_path}/shop", buckets=6)
        found = table(saved, "1998-08-02")
        assert "Exchange" not in plan(found)
        assert plan(found).count("Bucketed: true") == 4  # customers, orders twice, items
        assert "Exchange" in plan(table(plain, "1998-08-02"))
        assert rows(found) == rows(table(plain, "1998-08-02"))
        # Another session knows the files only.
        for name in layout.ORDER:
            layout._forget(spark, f"{tmp_path}/shop", name)
        again = layout.open_layout(spark, f"{tmp_path}/shop")
        assert "Exchange" not in plan(table(again, "1998-08-02"))
        assert rows(table(again, "1998-08-02")) == rows(found)


def test_a_hot_customer_is_left_to_the_shuffle(spark, tmp_path):
    many = [(i, 1 if i % 3 else i, "2024-01-05", 1.0) for i in range(600)]
    shop = Shop(customers(spark, *[(i, "2023-01-01") for i in range(0, 600)]), orders(spark, *many), items(spark, *[(i, f"c{i % 5}", 1, 1) for i in range(600)]))
    saved = layout.write_layout(shop, f"{tmp_path}/shop", buckets=16)
    assert not features.carries_customer(saved.order_items) and "Bucketed: true" not in plan(saved.orders)
    assert rows(table(saved)) == rows(table(shop))


def test_buckets_stay_small_enough_for_a_task(spark, tmp_path):
    many = spark.range(2_200_000).selectExpr("id % 4000 AS order_id", "'c' AS category", "1 AS quantity", "1.0 AS item_price")
    shop = Shop(customers(spark, *[(i, "2023-01-01") for i in range(2000)]), orders(spark, *[(i, i % 2000, "2024-01-05", 1.0) for i in range(4000)]), many)
    with settings(spark, {"spark.sql.requireAllClusterKeysForCoPartition": "true"}):
        saved = layout.write_layout(shop, f"{tmp_path}/shop")
        assert spark.read.json(f"{tmp_path}/shop/layout").first()["buckets"] == 3
        assert saved.order_items.count() == 2_200_000


def test_every_row_is_kept(spark, tmp_path):
    placed = orders(spark, (1, 7, "2024-01-05", 1.0), (2, None, "2024-01-06", 2.0), (2, None, "2024-01-06", 2.0), (3, 8, None, 3.0))
    sold = items(spark, (1, "a", 1, 1), (1, "a", 1, 1), (2, "b", 1, 1), (99, "c", 1, 1), (None, None, 1, 1))
    shop = Shop(customers(spark, (7, "2023-01-01"), (None, "2023-01-01")), placed, sold)
    with settings(spark, {"spark.sql.requireAllClusterKeysForCoPartition": "true"}):
        saved = layout.write_layout(shop, f"{tmp_path}/shop")
        assert rows(saved.customers) == rows(shop.customers) and rows(saved.orders) == rows(placed)
        assert rows(saved.order_items.drop("customer_id")) == rows(sold)
        empty = Shop(*[t.limit(0) for t in (shop.customers, placed, sold)])
        assert layout.write_layout(empty, f"{tmp_path}/empty").orders.count() == 0
    with pytest.raises(FileNotFoundError):
        layout.open_layout(spark, f"{tmp_path}/nothing")


def test_the_last_date_comes_from_the_footers(spark, tmp_path):
    path = f"{tmp_path}/orders"
    star.orders(spark, SMALL).repartition(3).write.parquet(path)
    text = plan(newest_in_files(spark, path, "order_date"))
    assert re.search(r"PushedAggregation: \[MAX\(order_date\)\]", text)
    assert last_date_in_files(spark, path) == last_date(spark.read.parquet(path))
    assert spark.conf.get("spark.sql.sources.useV1SourceList") != ""  # other scans stay as they are
    orders(spark, (1, 1, "2024-01-05", 1.0), (2, 1, None, 1.0)).repartition(2).write.parquet(f"{tmp_path}/nulls")
    assert last_date_in_files(spark, f"{tmp_path}/nulls") == dt.date(2024, 1, 5)
    orders(spark, (1, 1, None, 1.0)).write.parquet(f"{tmp_path}/none")
    assert last_date_in_files(spark, f"{tmp_path}/none") is None
    spark.read.parquet(path).limit(0).write.parquet(f"{tmp_path}/empty")
    assert last_date_in_files(spark, f"{tmp_path}/empty") is None


@pytest.mark.parametrize("side,slice_rows", [(2, 50), (2, 400), (4, 10**6)])
def test_slices_are_cut_until_they_are_small(spark, side, slice_rows, monkeypatch):
    levels = []
    cut = ordered._cut

    def noted(frame, keys, *rest):
        found, most = cut(frame, keys, *rest)
        levels.append(most)
        return found, most

    monkeypatch.setattr(ordered, "_cut", noted)
    frame = spark.range(4000).select(
        F.when(F.col("id") % 4 == 0, "small").otherwise("large").alias("g"),
        F.when(F.col("id") > 1, F.pow(F.col("id") * 7919 % 4001, F.lit(3.0))).alias("v"),
        (F.col("id") % 3).alias("x"),
    ).filter("not (g = 'large' and v is null)")
    found = ordered.running_totals(frame, "g", "v", {"x": "s"}, side=side, slice_rows=slice_rows).collect()
    wanted, total = {}, {}
    for r in sorted(frame.collect(), key=lambda r: (r["g"], r["v"] is None, -(r["v"] or 0))):
        total[r["g"]] = total.get(r["g"], 0) + r["x"]
        wanted[r["g"], r["v"]] = total[r["g"]]
    assert {(r["g"], r["v"]): r["s"] for r in found} == wanted and len(found) == len(wanted)
    assert levels[-1] <= side * side * slice_rows and len(levels) == {50: 4, 400: 2, 10**6: 1}[slice_rows]


def test_rows_that_add_nothing_end_the_cutting(spark):
    frame = spark.range(100).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"), F.lit(0).alias("x"))
    found = ordered.running_totals(frame, "g", "v", {"x": "s"}, side=2, slice_rows=1).collect()
    assert len(found) == 100 and {r["s"] for r in found} == {0}


def test_levels_pass_the_driver_by(spark):
    n = 100_000
    frame = spark.range(n).select(F.col("id").alias("k"), F.format_string("L%06d", "id").alias("g"), (F.col("id") % 3).alias("v"))
    assert matrix.category_levels(frame, ("g",)) is None
    design = matrix.Design.fit(frame, ("v",), ("g",))
    assert design.width == n and not design.levels
    vectors = design.assemble(frame, ["k"], design.fit_scaler(frame))
    assert len(vectors._jdf.queryExecution().toString()) < 5_000  # no slot is named in the plan
    some = {r["k"]: r for r in vectors.filter("k in (0, 4, 99999)").collect()}
    assert some[0]["features"].size == n and list(some[0]["features"].indices) == []
    assert list(some[4]["features"].indices) == [0, 4] and list(some[4]["features"].values) == [1.0, 1.0]
    assert list(some[99999]["features"].indices) == [n - 1]
    names = design.name_table(spark)
    assert names.count() == n and names.filter("place = 4").first()["feature"] == "g_L000004"

    class Model:
        featureImportances = some[4]["features"]

    ranked = importances(spark, Model, design.named(spark))
    assert ranked.count() == n and {r["feature"] for r in ranked.filter("importance > 0").collect()} == {"v", "g_L000004"}


def test_a_missing_number_stops_a_wide_matrix(spark):
    frame = spark.range(400).select(F.col("id").alias("k"), F.format_string("L%06d", "id").alias("g"), F.when(F.col("id") > 0, F.col("id")).alias("v"))
    with pytest.raises(Exception, match="v has no value"):
        matrix.Design.fit(frame, ("v",), ("g",)).assemble(frame, ["k"]).collect()
