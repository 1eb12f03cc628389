"""CSV and Parquet scans, sinks, and reuse of saved results."""

import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from custoria import session
from custoria.operators import reshape
from custoria.sources import files, sinks, star
from custoria.sources.readers import SchemaError, open_shop, open_visits, read_table
from custoria.sources.reuse import ResultStore, settle
from custoria.sources.schemas import CUSTOMERS, ORDERS, TABLES
from tests.conftest import SMALL


def write_text(path, text):
    path.write_text(text)
    return str(path)


def test_columns_are_found_by_name(spark, tmp_path):
    path = write_text(
        tmp_path / "customers.csv",
        "note,signup_date,customer_id,gender,age,city,acquisition_channel\n"
        "x,2024-02-29,7,F,33,Pune,Email\ny,,8,M,,Delhi,Organic\n",
    )
    frame = read_table(spark, path, CUSTOMERS)
    assert frame.schema.names == CUSTOMERS.names and [f.dataType for f in frame.schema] == [
        f.dataType for f in CUSTOMERS
    ]
    rows = {r["customer_id"]: r for r in frame.collect()}
    assert str(rows[7]["signup_date"]) == "2024-02-29" and rows[8]["signup_date"] is None and rows[8]["age"] is None


def test_missing_column_and_missing_path(spark, tmp_path):
    path = write_text(tmp_path / "orders.csv", "order_id,customer_id\n1,2\n")
    with pytest.raises(SchemaError, match="order_date"):
        read_table(spark, path, ORDERS)
    with pytest.raises(AnalysisException):
        read_table(spark, str(tmp_path / "nowhere.csv"), ORDERS)


def test_bad_value_stops_the_scan(spark, tmp_path):
    path = write_text(
        tmp_path / "orders.csv",
        "order_id,customer_id,order_date,order_value,discount_applied,payment_method\n1,2,not a date,5.0,0,Card\n",
    )
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|parse"):
        read_table(spark, path, ORDERS).collect()


def test_shop_survives_the_round_trip(spark, tmp_path):
    shop = star.shop(spark, SMALL)
    numbered = shop.order_items.withColumn("order_item_id", F.monotonically_increasing_id())
    for fmt in ("csv", "parquet"):
        folder = str(tmp_path / fmt)
        for name, frame in (("customers", shop.customers), ("orders", shop.orders), ("order_items", numbered)):
            sinks.write_result(frame, f"{folder}/{name}.{fmt}", fmt)
        again = open_shop(spark, folder, fmt)
        for got, wanted in ((again.customers, shop.customers), (again.orders, shop.orders)):
            assert got.exceptAll(wanted).count() == 0 and wanted.exceptAll(got).count() == 0
        assert again.order_items.count() == shop.order_items.count()


def test_visits_round_trip(spark, tmp_path):
    table = star.visits(spark, SMALL)
    path = sinks.write_result(table, str(tmp_path / "visits"))
    assert open_visits(spark, path).exceptAll(table).count() == 0
    assert set(TABLES) == {"customers", "orders", "order_items", "visits"}


def test_matrix_sink_has_one_sorted_file(spark, tmp_path):
    cells = spark.createDataFrame(
        [("2024-02-01", 0, 0.5), ("2024-01-01", 0, 1.0), ("2024-01-01", 1, 0.25)], "m string, i int, v double"
    ).withColumn("m", F.col("m").cast("date"))
    path = sinks.write_matrix(cells, str(tmp_path / "matrix"), "m", "i", "v")
    parts = [name for name in os.listdir(path) if name.startswith("part-")]
    assert len(parts) == 1
    text = open(f"{path}/{parts[0]}").read().split()
    assert text == ["m,0,1", "2024-01,1.0,0.25", "2024-02,0.5,"] or text == ["m,0,1", "2024-01,1.0,0.25", '2024-02,0.5,""']


def test_partitioned_sink(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a"), (2, "b")], "x int, p string")
    path = sinks.write_result(frame, str(tmp_path / "parts"), "parquet", ["p"])
    assert {"p=a", "p=b"} <= set(os.listdir(path))


def test_results_are_built_once_per_parameters(spark):
    store, built = ResultStore(spark), []

    def build(n):
        built.append(n)
        return spark.range(n)

    store.forget("numbers", n=3)
    for n in (3, 3, 4):
        assert store.get("numbers", lambda n=n: build(n), n=n).count() == n
    assert built == [3, 4] and store.has("numbers", n=3)
    store.forget("numbers", n=3)
    assert not store.has("numbers", n=3)
    store.get("numbers", lambda: build(3), n=3)
    assert built == [3, 4, 3]


def test_settled_frame_reads_back_from_the_shared_folder(spark):
    frame = settle(spark.range(5), "probe")
    assert frame.count() == 5
    assert all(session.shared_dir(spark).split(":")[-1] in name for name in frame.inputFiles())


def test_shared_folder_follows_the_setting(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        assert session.shared_dir(spark) == named.rstrip("/")
    assert spark.sparkContext.getCheckpointDir()


def test_a_cluster_must_name_the_shared_folder():
    class Conf:
        def get(self, key):
            return None

    class Context:
        master = "yarn"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_changed_inputs_and_racing_writers(spark, tmp_path):
    """A result is built anew when its input files change; of two writers one sound result is left; old ones go."""
    data, built = str(tmp_path / "in"), []
    spark.range(3).write.parquet(data)
    store = ResultStore(spark, str(tmp_path / "kept"))

    def build():
        built.append(spark.read.parquet(data).count())
        return spark.read.parquet(data).selectExpr("count(*) AS n")

    def n():
        return store.get("size", build, [spark.read.parquet(data)], kind=1).first()["n"]

    assert n() == n() == 3 and built == [3]
    spark.range(2).write.mode("append").parquet(data)
    assert n() == n() == 5 and built == [3, 5]
    spark.range(7).write.mode("overwrite").parquet(data)
    assert n() == 7

    def slower():
        inner = store.get("race", lambda: spark.range(1).selectExpr("'first' AS who"))
        assert inner.first()["who"] == "first"
        return spark.range(1).selectExpr("'second' AS who")

    assert store.get("race", slower).first()["who"] == "first"
    assert [p.name for p in (tmp_path / "kept" / "race").iterdir() if "." in p.name] == []
    assert store.evict("size", 1) == 2 and len(files.names(spark, str(tmp_path / "kept" / "size"))) == 1
    assert n() == 7 and built == [3, 5, 7]


def test_a_matrix_of_25000_labels(spark, tmp_path):
    """Beyond Spark's pivot limit: tiles side by side hold every cell at its label's place, empty ones included."""
    cells = spark.range(25_000).select(F.col("id").alias("c"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(None))).alias("r"), (F.col("id") * 2).alias("v"))
    cells = cells.filter("r is null or r = 1 or c % 1000 = 3")
    path = sinks.write_tiles(cells, str(tmp_path / "wide"), "r", "c", "v", tile=10_000)
    places = spark.read.csv(f"{path}/labels", header=True, inferSchema=True)
    assert places.count() == 25_000 and places.filter("c <> place").count() == 0
    widths = []
    for tile in range(3):
        rows = {r["label"]: r["cells"] for r in sinks.read_tile(spark, path, tile).collect()}
        assert set(rows) == {"1", "2", ""}
        widths.append(len(rows["1"]))
        for at, (full, few, none) in enumerate(zip(rows["1"], rows["2"], rows[""])):
            place = tile * 10_000 + at
            assert full == none == str(2 * place) and few == (str(2 * place) if place % 1000 == 3 else None)
    assert widths == [10_000, 10_000, 5_000]


def test_numbers_follow_the_order(spark):
    table = spark.createDataFrame([(f"v{i % 700:04d}",) for i in range(5000)] + [(None,)], "v string").repartition(7)
    found = {r["v"]: r["place"] for r in reshape.numbered(table, "v").collect()}
    assert found == {f"v{i:04d}": i for i in range(700)}
    assert reshape.numbered(table.limit(0), "v").count() == 0
