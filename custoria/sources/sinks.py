"""Result sinks: tables and labelled matrices, with a way to read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_result(frame: DataFrame, path: str, fmt: str = "csv", partition_by: list[str] | None = None) -> str:
    """Write a result table without an index column; each task writes its own part file."""
    writer = frame.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("dateFormat", "yyyy-MM-dd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def write_matrix(
    cells: DataFrame, path: str, row: str, column: str, value: str, columns: list | None = None, fmt: str = "csv"
) -> str:
    """Write long cells as a matrix: one line per `row`, its label first, sorted by it.

    The lines are sorted by range, so that a long matrix is written by many tasks, in order of their part files.
    """
    from custoria.operators.reshape import to_matrix

    labelled = to_matrix(cells, row, column, value, columns)
    if dict(labelled.dtypes)[row] == "date":
        labelled = labelled.withColumn(row, F.date_format(row, "yyyy-MM"))
    return write_result(labelled.orderBy(row), path, fmt)


def write_tiles(cells: DataFrame, path: str, row: str, column: str, value: str, tile: int | None = None) -> str:
    """Write long cells as a matrix of any width: `path/labels` and `path/tiles/tile=K`.

    labels says which label is at which place. Each tile holds a line per row, its label first and then the values of the
    tile's places, by commas, sorted by row; all tiles have the same rows, so they can be pasted side by side.
    """
    from custoria.operators.reshape import TILE, to_tiles

    index, tiles = to_tiles(cells, row, column, value, tile or TILE)
    write_result(index.orderBy("place"), f"{path}/labels")
    label = F.date_format(row, "yyyy-MM") if dict(cells.dtypes)[row] == "date" else F.col(row).cast("string")
    texts = F.array_join(F.transform("cells", lambda v: F.coalesce(v.cast("string"), F.lit(""))), ",")
    lines = tiles.select("tile", F.concat_ws(",", F.coalesce(label, F.lit("")), texts).alias("value"), F.col(row).alias("_row"))
    sorted_lines = lines.repartitionByRange("tile", "_row").sortWithinPartitions("tile", "_row")
    sorted_lines.select("tile", "value").write.mode("overwrite").partitionBy("tile").text(f"{path}/tiles")
    return path


def read_tile(spark: SparkSession, path: str, tile: int) -> DataFrame:
    """(label, cells): the rows of one tile with their values as texts, empty ones as nulls."""
    parts = F.split("value", ",")
    return spark.read.text(f"{path}/tiles/tile={tile}").select(
        F.get(parts, F.lit(0)).alias("label"), F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda v: F.nullif(v, F.lit(""))).alias("cells")
    )
