"""Pivot, unpivot and positional or ranked selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from custoria.operators.bounds import sized

#: Labels of a matrix that stand side by side in one tile.
TILE = 4_096


def to_matrix(cells: DataFrame, row: str, column: str, value: str, columns: list | None = None) -> DataFrame:
    """Long cells to a matrix with a column per label. Naming the `columns` saves the job that looks them up.

    A cell whose label is not among the named columns is an error. Labels that are looked up become columns, so more than
    Spark's own pivot limit of them is an error, too (`to_tiles` has none); cells without a label belong to no column.
    """
    if columns is None:
        columns = matrix_labels(cells, column)
    listed = F.col(column).isNull() | F.col(column).isin(columns)
    told = F.concat(F.lit(f"no column is named for {column} "), F.col(column).cast("string"))
    checked = cells.withColumn(column, F.when(listed, F.col(column)).otherwise(F.raise_error(told)))
    wide = checked.groupBy(row).pivot(column, columns).agg(F.first(value))
    return wide.select(row, *[F.col(f"`{name}`").alias(str(name)) for name in columns])


def matrix_labels(cells: DataFrame, column: str) -> list:
    """The distinct labels in order: as many as a matrix has columns, which Spark limits."""
    most = int(cells.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    found = cells.select(column).filter(F.col(column).isNotNull()).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} labels of {column} for the columns of a matrix")
    return sorted(entry[0] for entry in found)


def numbered(frame: DataFrame, column: str, name: str = "place") -> DataFrame:
    """The distinct values of `column`, nulls left out, numbered from 0 in their order.

    Ranges of values are sorted by a task each and saved; counts per range, which are few, give the number each one begins
    with. Neither the driver nor one task sees all values.
    """
    spread = frame.select(column).filter(F.col(column).isNotNull()).distinct().repartitionByRange(F.col(column))
    spread = spread.sortWithinPartitions(column).select(column, F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at"))
    saved = sized(spread, "numbered")
    ranges = saved.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per task
    starts = ranges.select("_range", (before - F.col("_first")).alias("_shift"))
    return saved.join(F.broadcast(starts), "_range").select(column, (F.col("_at") + F.col("_shift")).alias(name))


def to_tiles(cells: DataFrame, row: str, column: str, value: str, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Long cells to a matrix of any width, as tiles that stand side by side.

    Gives (`column`, place): which label is at which place; and (`row`, tile, cells): for every row and tile the values at
    its places in order, null where there is none. A row's cells are gathered tile by tile, never all at once.
    """
    index = sized(numbered(cells, column), "labels")
    width = index.agg(F.count(F.lit(1)).alias("n"))
    at = F.col("place")
    placed = cells.join(index, column).select(row, F.floor(at / tile).cast("int").alias("tile"), (at % tile).cast("int").alias("inside"), F.col(value).alias("_v"))
    single = placed.groupBy(row, "tile", "inside").agg(F.first("_v").alias("_v"))
    filled = single.groupBy(row, "tile").agg(F.map_from_entries(F.collect_list(F.struct("inside", "_v"))).alias("_m"))
    n = width.select("n").scalar()
    grid = cells.select(row).distinct().select(row, F.explode(F.sequence(F.lit(0), F.floor((n - 1) / tile).cast("int"))).alias("tile"))
    grid = grid.withColumn("_width", F.least(F.lit(tile), (n - F.col("tile") * tile).cast("int")))
    places = F.sequence(F.lit(0), F.col("_width") - 1)
    empty = F.transform(places, lambda i: F.lit(None).cast(dict(cells.dtypes)[value]))
    full = F.coalesce(F.transform(places, lambda i: F.try_element_at("_m", i)), empty)
    joined = grid.join(filled, (grid[row].eqNullSafe(filled[row])) & (grid["tile"] == filled["tile"]), "left")
    return index, joined.select(grid[row], grid["tile"], full.alias("cells"))


def to_long(matrix: DataFrame, row: str, name: str, value: str) -> DataFrame:
    """Matrix back to long cells, empty cells included."""
    return matrix.unpivot([row], [c for c in matrix.columns if c != row], name, value)


def first_labels(cells: DataFrame, **most: int) -> DataFrame:
    """The top left corner of a matrix: per column in `most`, cells with one of its lowest labels.

    Position counts, not value, and every axis is that of the whole matrix.
    """
    corner = cells
    for column, n in most.items():
        lowest = cells.select(column).distinct().orderBy(column).limit(n)
        corner = corner.join(F.broadcast(lowest), column, "left_semi")  # n rows
    return corner


def best_row(frame: DataFrame, score: str, tie: str, by: list[str] | None = None) -> DataFrame:
    """The row with the highest score; ties take the lowest `tie`. One per group with `by`."""
    if not by:
        return frame.orderBy(F.desc(score), tie).limit(1)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie))
    return frame.withColumn("place", rank).filter("place = 1").drop("place")


def top_rows(frame: DataFrame, score: str, tie: str, k: int) -> DataFrame:
    """The `k` highest scores."""
    return frame.orderBy(F.desc(score), tie).limit(k)
