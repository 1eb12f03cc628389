"""From a feature table to a model matrix: dummies, scaling, class weights, vectors."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from custoria.functions.columns import as_double, ratio
from custoria.operators.bounds import sized
from custoria.operators.reshape import numbered
from custoria.session import scratch_path

# Fixed column sets of the two models; the short variants are those of the interactive pages.
CHURN_NUMERIC = (
    "total_orders",
    "total_spend",
    "avg_order_value",
    "recency_days",
    "order_frequency",
    "discount_rate",
    "category_diversity",
    "age",
)
CHURN_CATEGORIES = ("gender", "acquisition_channel", "preferred_payment", "city")
SPEND_NUMERIC = ("total_orders", "total_spend", "avg_order_value", "recency_days", "order_frequency", "age")
SPEND_CATEGORIES = ("gender", "acquisition_channel", "city")
SHORT_CATEGORIES = ("gender", "acquisition_channel")

#: Beyond this many dummies they are a sparse vector instead of a column each.
WIDE = 300


def category_levels(table: DataFrame, columns: tuple[str, ...], most: int = WIDE) -> dict[str, list[str]] | None:
    """Sorted distinct values of every category column, in one job: the names of the matrix columns.

    None if there are more than `most` of them in all; no more than that ever reach the driver.
    """
    if not columns:
        return {}
    pairs = (
        table.select(*[F.col(c).cast("string").alias(c) for c in columns])
        .unpivot([], list(columns), "column", "level")
        .filter(F.col("level").isNotNull())
        .distinct()
        .limit(most + 1)
        .collect()
    )
    if len(pairs) > most:
        return None
    return {c: sorted(p["level"] for p in pairs if p["column"] == c) for c in columns}


@dataclass(frozen=True)
class Codes:
    """The distinct values of one category column as a saved table (level, place), numbered in their order."""

    table: DataFrame
    size: int

    @staticmethod
    def fit(table: DataFrame, column: str) -> Codes:
        """Ranges of levels are sorted by a task each; the driver learns only how many there are."""
        places = sized(numbered(table.select(F.col(column).cast("string").alias("level")), "level"), "levels")
        return Codes(places, places.count())

    @property
    def slots(self) -> int:
        """Matrix columns: one per level but the first."""
        return max(0, self.size - 1)


def dummy_columns(levels: dict[str, list[str]]) -> dict[str, Column]:
    """One 0/1 column per level except the first of each category; null and unknown are all 0."""
    return {
        f"{column}_{level}": F.coalesce((F.col(column) == level).cast("int"), F.lit(0))
        for column, values in levels.items()
        for level in values[1:]
    }


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation per column; a constant column is only centred."""

    mean: dict[str, float]
    deviation: dict[str, float]

    @staticmethod
    def fit(train: DataFrame, columns: dict[str, Column]) -> Scaler:
        """One aggregate over the training rows; two numbers per column reach the driver."""
        names = list(columns)
        row = train.agg(
            *[F.avg(as_double(columns[n])).alias(f"m{i}") for i, n in enumerate(names)],
            *[F.stddev_pop(as_double(columns[n])).alias(f"s{i}") for i, n in enumerate(names)],
        ).first()
        return Scaler(
            {n: row[f"m{i}"] or 0.0 for i, n in enumerate(names)},
            {n: row[f"s{i}"] or 1.0 for i, n in enumerate(names)},
        )

    def scaled(self, name: str, value: Column) -> Column:
        return (as_double(value) - self.mean[name]) / self.deviation[name]


@dataclass(frozen=True)
class SparseScaler:
    """Population deviations of sparse features. They are not centred, which keeps them sparse and leaves every fit with an
    unpenalised intercept as it is. Those of dummies stay a table per category: (level, place, deviation)."""

    numeric: tuple[float, ...]
    coded: dict[str, DataFrame]

    @staticmethod
    def fit(train: DataFrame, numeric: tuple[str, ...], codes: dict[str, Codes]) -> SparseScaler:
        """One aggregate of the numeric columns and one count per level; a level that training rows lack, like a constant
        column, has deviation 1."""
        row = train.agg(
            F.count(F.lit(1)).alias("n"), *[F.stddev_pop(as_double(c)).alias(f"s{i}") for i, c in enumerate(numeric)]
        ).first()
        tables = {}
        for column, own in codes.items():
            counts = train.groupBy(F.col(column).cast("string").alias("_level")).agg(F.count(F.lit(1)).alias("_n"))
            share = F.col("_n") / F.lit(float(row["n"] or 1))
            spread = F.sqrt(share * (1 - share))
            joined = own.table.join(counts, F.col("level") == F.col("_level"), "left")
            tables[column] = sized(joined.select("level", "place", F.when(spread > 0, spread).otherwise(1.0).alias("deviation")), "deviations")
        return SparseScaler(tuple(row[f"s{i}"] or 1.0 for i in range(len(numeric))), tables)


@dataclass(frozen=True)
class Design:
    """The ordered matrix columns: numeric ones, then the dummies.

    Up to `WIDE` levels are listed in `levels` and become a column each. Beyond that they stay tables, in `codes`, and rows
    become sparse vectors by joins with them, so that any number of levels passes the driver by.
    """

    numeric: tuple[str, ...]
    levels: dict[str, list[str]] = field(default_factory=dict)
    codes: dict[str, Codes] = field(default_factory=dict)

    @staticmethod
    def fit(table: DataFrame, numeric: tuple[str, ...], categories: tuple[str, ...]) -> Design:
        levels = category_levels(table, tuple(categories))
        if levels is not None:
            return Design(tuple(numeric), levels)
        return Design(tuple(numeric), codes={c: Codes.fit(table, c) for c in categories})

    @property
    def columns(self) -> dict[str, Column]:
        return {**{n: as_double(n) for n in self.numeric}, **dummy_columns(self.levels)}

    @property
    def wide(self) -> bool:
        return bool(self.codes)

    @property
    def width(self) -> int:
        """Number of matrix columns."""
        few = sum(max(0, len(values) - 1) for values in self.levels.values())
        return len(self.numeric) + few + sum(own.slots for own in self.codes.values())

    @property
    def names(self) -> list[str]:
        """All names, in order. Those of a wide matrix are collected; `name_table` has them where they are."""
        if self.wide:
            return [r["feature"] for r in self.name_table(next(iter(self.codes.values())).table.sparkSession).orderBy("place").collect()]
        return [*self.numeric, *(f"{c}_{level}" for c, values in self.levels.items() for level in values[1:])]

    def name_table(self, spark: SparkSession) -> DataFrame:
        """(place, feature): the matrix columns and their names."""
        start = len(self.numeric)
        if not self.wide:
            return spark.createDataFrame(list(enumerate(self.names)), "place bigint, feature string")
        table = spark.createDataFrame(list(enumerate(self.numeric)), "place bigint, feature string")
        for column, own in self.codes.items():
            name = F.concat(F.lit(f"{column}_"), F.col("level"))
            table = table.unionByName(own.table.filter("place > 0").select((F.col("place") - 1 + start).alias("place"), name.alias("feature")))
            start += own.slots
        return table

    def named(self, spark: SparkSession) -> list[str] | DataFrame:
        """The names as a list, or as a table where they are too many for the driver."""
        return self.name_table(spark) if self.wide else self.names

    def fit_scaler(self, train: DataFrame) -> Scaler | SparseScaler:
        return SparseScaler.fit(train, self.numeric, self.codes) if self.wide else Scaler.fit(train, self.columns)

    def _sparse(self, table: DataFrame, keep: list[str], scaler: SparseScaler | None) -> DataFrame:
        """`keep` columns, `features` and, given a scaler, `scaled`: each category is looked up in its table of levels.

        The vectors are put together by column functions, written as the structures that vectors are in files, and read back
        as vectors. Spark's own encoder would name every slot in the plan, on the driver.
        """
        spark = table.sparkSession
        flat = table.select(
            *keep,
            *[as_double(c).alias(f"_x{i}") for i, c in enumerate(self.numeric)],
            *[F.col(c).cast("string").alias(f"_c{i}") for i, c in enumerate(self.codes)],
        )
        slots, start = [], len(self.numeric)
        for i, c in enumerate(self.numeric):
            missing = F.raise_error(F.lit(f"{c} has no value in some row")).cast("double")
            slots.append((F.lit(i), F.coalesce(F.col(f"_x{i}"), missing), F.lit(scaler.numeric[i] if scaler else 1.0)))
        for i, (column, own) in enumerate(self.codes.items()):
            found = scaler.coded[column] if scaler else own.table.withColumn("deviation", F.lit(1.0))
            found = found.select(F.col("level").alias(f"_l{i}"), F.col("place").alias(f"_p{i}"), F.col("deviation").alias(f"_d{i}"))
            flat = flat.join(found, F.col(f"_c{i}") == F.col(f"_l{i}"), "left")
            # The first level, null and unknown values have no slot.
            slots.append((F.when(F.col(f"_p{i}") > 0, F.col(f"_p{i}") - 1 + start), F.lit(1.0), F.col(f"_d{i}")))
            start += own.slots

        def vector(values: list[tuple[Column, Column]]) -> Column:
            pairs = F.array(*[F.struct(at.cast("int").alias("at"), value.alias("value")) for at, value in values])
            full = F.filter(pairs, lambda e: e["at"].isNotNull() & (e["value"] != 0))
            return F.struct(
                F.lit(0).cast("tinyint").alias("type"),
                F.lit(start).alias("size"),
                F.transform(full, lambda e: e["at"]).alias("indices"),
                F.transform(full, lambda e: e["value"]).alias("values"),
            )

        built = {"features": vector([(at, value) for at, value, _ in slots])}
        if scaler:
            built["scaled"] = vector([(at, value / spread) for at, value, spread in slots])
        rows = flat.select(*keep, *[value.alias(name) for name, value in built.items()])
        path = scratch_path(spark, "sparse")
        rows.write.parquet(path)
        schema = T.StructType([*rows.select(*keep).schema, *[T.StructField(name, VectorUDT()) for name in built]])
        return spark.read.schema(schema).parquet(path)

    def assemble(self, table: DataFrame, keep: list[str], scaler: Scaler | SparseScaler | None = None) -> DataFrame:
        """`keep` columns, the vector `features` and, given a scaler, the vector `scaled`."""
        if self.wide:
            return self._sparse(table, keep, scaler)
        columns = self.columns
        # Short internal names: a level may hold dots or blanks.
        parts = {f"x{i}": as_double(columns[n]) for i, n in enumerate(columns)}
        if scaler:
            parts |= {f"z{i}": scaler.scaled(n, columns[n]) for i, n in enumerate(columns)}
        flat = table.select(*keep, *[value.alias(name) for name, value in parts.items()])
        plain = [f"x{i}" for i in range(len(columns))]
        flat = VectorAssembler(inputCols=plain, outputCol="features").transform(flat)
        if scaler:
            scaled = [f"z{i}" for i in range(len(columns))]
            flat = VectorAssembler(inputCols=scaled, outputCol="scaled").transform(flat)
        return flat.drop(*parts)


def class_counts(table: DataFrame, label: str) -> DataFrame:
    return table.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def balanced_weights(table: DataFrame, train: DataFrame, label: str, name: str = "balanced") -> DataFrame:
    """Add n / (classes x n of the class), counted on the training rows."""
    sizes = class_counts(train, label)
    both = sizes.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes"))
    weights = sizes.select(
        label,
        ratio(
            both.select("rows").scalar(), F.col("n") * both.select("classes").scalar()
        ).alias(name),
    )
    return table.join(sized(weights, "class-weights"), label)


def positive_weights(
    table: DataFrame, train: DataFrame, label: str, guarded: bool = True, name: str = "positive_weight"
) -> DataFrame:
    """Add negatives / positives for class 1 and 1 for class 0, counted on the training rows."""
    counts = train.agg(
        F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos")
    )
    bottom = F.greatest("pos", F.lit(1)) if guarded else F.col("pos")
    share = counts.select(ratio("neg", bottom).alias("w")).scalar()
    return table.withColumn(name, F.when(F.col(label) == 1, share).otherwise(F.lit(1.0)))
