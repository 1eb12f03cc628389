"""Run queries next to their SQL twins in DuckDB and compare schema and values."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, dt.datetime):
        return value.date() if value.time() == dt.time() else value
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, decimal.Decimal):
        raise TypeError("decimals must be cast before the comparison")
    return value


def _kind(name: str) -> str:
    name = name.lower()
    for kind, words in {
        "bigint": ("bigint", "longtype", "long"),
        "int": ("integer", "int"),
        "double": ("double",),
        "string": ("varchar", "string"),
        "date": ("date",),
        "boolean": ("boolean",),
    }.items():
        if name in words:
            return kind
    return name


def spark_rows(frame):
    columns = sorted(frame.columns)
    kinds = dict(frame.dtypes)
    rows = [tuple(_plain(row[c]) for c in columns) for row in frame.collect()]
    return columns, [_kind(kinds[c]) for c in columns], rows


def sql_rows(connection, text):
    cursor = connection.execute(text)
    described = [(d[0], str(d[1])) for d in cursor.description]
    order = sorted(range(len(described)), key=lambda i: described[i][0])
    rows = [tuple(_plain(row[i]) for i in order) for row in cursor.fetchall()]
    return [described[i][0] for i in order], [_kind(described[i][1]) for i in order], rows


def _key(row):
    return tuple((v is None, str(type(v)) if v is None else "", v if v is not None else 0) for v in row)


def difference(got, wanted) -> str | None:
    """None when equal bit by bit, else the first difference in words."""
    for what, a, b in zip(("columns", "types"), got[:2], wanted[:2]):
        if a != b:
            return f"{what}: {a} against {b}"
    if len(got[2]) != len(wanted[2]):
        return f"rows: {len(got[2])} against {len(wanted[2])}"
    for a, b in zip(sorted(got[2], key=_key), sorted(wanted[2], key=_key)):
        if a != b:
            return f"first different row: {a} against {b}"
    return None


def main(folder: str, names: list[str]) -> int:
    import checks

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    bad = 0
    for name, run in checks.QUERIES.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        begin = time.time()
        try:
            got = spark_rows(run(spark, folder))
            twin = checks.TWINS.get(name)
            verdict = difference(got, sql_rows(connection, twin)) if twin else None
            note = f"{len(got[2])} rows" + ("" if twin else ", no twin")
        except Exception as error:  # report and go on with the next query
            verdict, note = f"{type(error).__name__}: {str(error)[:600]}", ""
        bad += verdict is not None
        print(f"{'ok  ' if verdict is None else 'FAIL'} {time.time() - begin:6.2f}s {name} {note} {verdict or ''}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
