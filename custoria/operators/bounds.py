"""Joins with small tables, planned on their true size."""

from __future__ import annotations

from pyspark.sql import DataFrame

from custoria.sources.reuse import settle


def sized(frame: DataFrame, label: str = "small") -> DataFrame:
    """`frame` saved and read back, so that a join sees how large it is.

    Spark knows the size of a saved table and broadcasts it below its own limit; beyond, the join shuffles. The size of an
    aggregate, in contrast, is a guess before it ran, and the other side would be shuffled for nothing.
    """
    return settle(frame, label)
