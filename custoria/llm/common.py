"""Session preparation and small helpers shared by the corpus operators."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custoria.session import scratch_path, tune
from custoria.sources.reuse import settle

__all__ = ["HELD_OUT_OF", "held_out", "prepare", "read", "scratch_path", "settle", "text_column", "with_text"]

#: Rows whose crc32(doc_id as text) leaves no remainder here are held out from training.
HELD_OUT_OF = 5

#: Python workers hold a few batches at once, so a batch is this many texts at most.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> SparkSession:
    """Settings every corpus operator relies on. Task code travels by value, so executors need no installed package."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    cloudpickle.register_pickle_by_value(sys.modules["custoria.llm"])
    return spark


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def text_column() -> Column:
    """The text; null is the empty text."""
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def with_text(documents: DataFrame, *columns: str) -> DataFrame:
    """`doc_id`, the named columns and `text` with nulls as empty texts; any other column is left behind."""
    return documents.select("doc_id", *columns, text_column().alias("text"))


def held_out() -> Column:
    """True where a row may not be learned from. A row without id is never held out and never has a label."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT_OF == 0, F.lit(False))
