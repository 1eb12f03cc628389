"""Running totals along a global order without sorting everything in one task."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from custoria.operators.bounds import sized

# Slices per group are SIDE x SIDE: two short look-ups find a value's slice among them.
SIDE = 32
#: Rows that one slice should hold; where a group has more per slice, every slice is cut again.
SLICE_ROWS = 4_000_000


def _coarse(cuts: str, side: int) -> Column:
    """Every `side`-th cut."""
    return F.transform(F.sequence(F.lit(1), F.lit(side - 1)), lambda place: F.element_at(cuts, place * side))


def _above(cuts: str, order: str) -> Column:
    """How many of the cuts lie above the value."""
    return F.size(F.filter(cuts, lambda cut: cut > F.col(order)))


def _cut(frame: DataFrame, keys: list[str], order: str, adds: Column, side: int) -> tuple[DataFrame, int]:
    """`frame` with `_part`, the number of its quantile slice among the rows with equal `keys`, from the top; nulls come last.

    Also the most rows that any of these sets of rows holds.
    """
    slices = side * side
    at = [i / slices for i in range(1, slices)]
    quantiles = F.percentile_approx(F.when(adds, F.col(order)), at, 20 * slices)
    cuts = frame.groupBy(*keys).agg(quantiles.alias("_cuts"), F.count(F.lit(1)).alias("_rows")).select(
        *[F.col(key).alias(f"_key{i}") for i, key in enumerate(keys)], "_cuts", _coarse("_cuts", side).alias("_coarse"), "_rows"
    )
    cuts = sized(cuts, "cuts")
    most = cuts.agg(F.max("_rows")).first()[0] or 0
    same = reduce(and_, [F.col(key).eqNullSafe(F.col(f"_key{i}")) for i, key in enumerate(keys)])
    place = (
        F.when(F.col(order).isNull(), slices)
        .when(F.col("_cuts").isNull(), 0)  # no row adds anything
        .otherwise(side * F.col("_upper") + _above("_block", order))
    )
    parted = (
        frame.join(cuts.drop("_rows"), same)
        .withColumn("_upper", _above("_coarse", order))
        .withColumn("_block", F.slice("_cuts", side * (side - 1 - F.col("_upper")) + 1, side - 1))
        .withColumn("_part", place.cast("bigint"))
    )
    return parted.drop("_cuts", "_coarse", "_upper", "_block", *[f"_key{i}" for i in range(len(keys))]), most


def running_totals(
    frame: DataFrame, group: str, order: str, totals: dict[str, str], side: int = SIDE, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Inclusive running sums by descending `order` within each `group`.

    `totals` maps source columns to names of their running sums. `order` must be unique within
    the group (aggregate first), so that no slice can be hot; nulls of it come last. Approximate quantiles cut each
    group into slices of about equal size; a row's total is the exact total of the slices above
    plus its running sum inside the slice, hence exact wherever the cuts fall. Rows with a null group form a group of
    their own.

    Slices follow the data: while the largest group has more than `slice_rows` rows a slice, every slice is cut in the same
    way again, so that sorting one stays within a task's memory at any number of rows.

    `frame` feeds three branches, so pass a saved table or an aggregate of one.
    """
    slices = side * side
    # Rows that add nothing matter neither to the cuts nor to the sums. Asking for them keeps the
    # columns of all three branches equal, so that the shuffle of `frame` runs once and is reused.
    adds = reduce(or_, [F.col(c) != 0 for c in totals])
    sliced, most = _cut(frame, [group], order, adds, side)
    sliced = sliced.withColumnRenamed("_part", "_slice")
    before = None
    while most > slices * slice_rows and most != before:  # only rows that add nothing can stay together
        before = most
        finer, most = _cut(sized(sliced, "slices"), [group, "_slice"], order, adds, side)
        sliced = finer.withColumn("_slice", F.col("_slice") * (slices + 1) + F.col("_part")).drop("_part")

    sums = sliced.groupBy(group, "_slice").agg(*[F.sum(c).alias(f"_all_{c}") for c in totals])
    higher = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col(group).alias("_group"),
        F.col("_slice").alias("_part"),
        *[F.coalesce(F.sum(f"_all_{c}").over(higher), F.lit(0)).alias(f"_off_{c}") for c in totals],
    )
    inside = (
        Window.partitionBy(group, "_slice").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    )
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_slice") == F.col("_part"))
    return (
        sliced.withColumns({f"_in_{c}": F.sum(c).over(inside) for c in totals})
        .join(sized(offsets, "offsets"), same)
        .select(
            *frame.columns,
            *[(F.col(f"_in_{c}") + F.col(f"_off_{c}")).alias(name) for c, name in totals.items()],
        )
    )
