"""Sources, projections, joins, aggregates, windows, sorts, reshapes and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from checks.registry import query, sql
from custoria.functions.columns import (
    as_double,
    day_count,
    money_sum,
    month_label,
    month_of,
    months_between,
    percent,
    ratio,
    rupees,
    thousands,
)
from custoria.operators import cohorts, experiment, features, labels, overview, reshape
from custoria.operators.horizon import eligible, horizon, last_date_in_files, observed, outcome
from custoria.session import scratch_path
from custoria.sources import sinks, star
from custoria.sources.readers import read_table
from custoria.sources.reuse import ResultStore, settle
from custoria.sources.schemas import CUSTOMERS, ORDER_ITEMS, ORDERS

ORDER_COLUMNS = "order_id, customer_id, order_date, order_value, discount_applied, payment_method"


def cells(shop):
    return cohorts.cohort_cells(shop.orders, shop.customers)


# ---- sources and sinks ----------------------------------------------------------------------


@query("S01_csv_scan", sql("ord", f"SELECT {ORDER_COLUMNS} FROM ord"))
def s01(spark, folder):
    path = sinks.write_result(star.orders(spark, folder), scratch_path(spark, "orders-csv"))
    return read_table(spark, path, ORDERS)


@query("S01_csv_scan_customers", sql("cust", "SELECT * FROM cust"))
def s01_customers(spark, folder):
    path = sinks.write_result(star.customers(spark, folder), scratch_path(spark, "customers-csv"))
    return read_table(spark, path, CUSTOMERS)


@query("S01_csv_scan_order_items", sql("item", "SELECT order_id, category, quantity, item_price FROM item"))
def s01_items(spark, folder):
    items = star.shop(spark, folder).order_items
    path = sinks.write_result(items, scratch_path(spark, "items-csv"))
    fields = [f for f in ORDER_ITEMS if f.name in items.columns]
    return read_table(spark, path, T.StructType(fields)).select("order_id", "category", "quantity", "item_price")


@query(
    "S02_csv_sink",
    sql(
        "ord item",
        """SELECT category, CAST(sum(price * quantity) AS DOUBLE) AS revenue
        FROM item JOIN ord USING (order_id) GROUP BY category""",
    ),
)
def s02(spark, folder):
    shop = star.shop(spark, folder)
    table = overview.revenue_by_category(shop.orders, shop.order_items)
    path = sinks.write_result(table, scratch_path(spark, "category-csv"))
    schema = T.StructType([T.StructField("category", T.StringType()), T.StructField("revenue", T.DoubleType())])
    return read_table(spark, path, schema)


def lines_sql(source: str, value: str, row: str = "cohort_month", scale: int = 1) -> str:
    """The matrix as a text per row, empty cells included; the columns follow from the data here as well."""
    return f"""
    SELECT {row} AS cohort_month, string_agg(coalesce(CAST(CAST(floor({value} * {scale} + 0.5) AS BIGINT) AS VARCHAR), ''), ',' ORDER BY i) AS line
    FROM (SELECT DISTINCT cohort_month FROM {source}) CROSS JOIN (SELECT DISTINCT cohort_index AS i FROM {source})
         LEFT JOIN (SELECT cohort_month, cohort_index AS i, {value} FROM {source}) USING (cohort_month, i)
    GROUP BY 1"""


MILLION = 1_000_000


def lines(matrix, scale: int = 1, row: str = "cohort_month"):
    """A wide matrix as (row, line): scaled whole numbers by commas, so that no number depends on how it is printed."""
    whole = lambda c: F.floor(F.col(f"`{c}`") * scale + 0.5).cast("bigint").cast("string")
    return matrix.select(row, F.concat_ws(",", *[F.coalesce(whole(c), F.lit("")) for c in matrix.columns if c != row]).alias("line"))


@query("S03_matrix_sink", sql("retained", lines_sql("retained", "retention", "strftime(cohort_month, '%Y-%m')", MILLION)))
def s03(spark, folder):
    table = settle(cohorts.retention(cells(star.shop(spark, folder))), "retention")
    path = sinks.write_matrix(table, scratch_path(spark, "retention-csv"), "cohort_month", "cohort_index", "retention")
    labels_ = reshape.matrix_labels(table, "cohort_index")
    schema = T.StructType(
        [T.StructField("cohort_month", T.StringType())] + [T.StructField(str(m), T.DoubleType()) for m in labels_]
    )
    return lines(read_table(spark, path, schema), MILLION)


@query("S03_matrix_tiles", sql("retained", lines_sql("retained", "retention", "strftime(cohort_month, '%Y-%m')", MILLION)))
def s03_tiles(spark, folder):
    """The same matrix in tiles of five months, read back tile by tile and put side by side."""
    table = settle(cohorts.retention(cells(star.shop(spark, folder))), "retention")
    path = sinks.write_tiles(table, scratch_path(spark, "retention-tiles"), "cohort_month", "cohort_index", "retention", tile=5)
    tiles = spark.read.csv(f"{path}/labels", header=True).count()
    beside = None
    for tile in range(-(-tiles // 5)):
        part = sinks.read_tile(spark, path, tile).withColumnRenamed("cells", f"t{tile}")
        beside = part if beside is None else beside.join(part, "label")
    every = F.concat(*[c for c in beside.columns if c != "label"])
    whole = F.transform(every, lambda v: F.coalesce(F.floor(v.cast("double") * MILLION + 0.5).cast("bigint").cast("string"), F.lit("")))
    return beside.select(F.col("label").alias("cohort_month"), F.array_join(whole, ",").alias("line"))


def label_sql(days: int) -> str:
    return f"""
    SELECT customer_id, CAST(customer_id NOT IN (
             SELECT customer_id FROM ord, span WHERE order_date > max_date - {days}) AS INTEGER) AS churned
    FROM cust, span WHERE signup_date <= max_date - {days}"""


@query("S04_result_reuse", sql("cust ord span", label_sql(60)))
def s04(spark, folder):
    shop = star.shop(spark, folder)
    store, inputs = ResultStore(spark), [shop.customers, shop.orders]

    def build():
        return labels.churn_labels(shop.customers, shop.orders, horizon(shop.orders, 60))

    store.get("churn-labels", build, inputs, window_days=60)
    return store.get("churn-labels", build, inputs, window_days=60)


@query(
    "S05_profile",
    sql(
        "cust ord item",
        """SELECT 'customers' AS table_name, count(*) AS row_count, min(signup_date) AS first_date,
               max(signup_date) AS last_date FROM cust
        UNION ALL SELECT 'orders', count(*), min(order_date), max(order_date) FROM ord
        UNION ALL SELECT 'order_items', count(*), NULL, NULL FROM item""",
    ),
)
def s05(shop):
    return overview.profile(shop)


# ---- projections, filters, nulls ------------------------------------------------------------


@query("P01_column_subset", sql("cust", "SELECT customer_id, signup_date FROM cust"))
def p01(shop):
    return shop.customers.select("customer_id", "signup_date")


@query("P02_column_drop", sql("cust", "SELECT * EXCLUDE (city, age) FROM cust"))
def p02(shop):
    return shop.customers.drop("city", "age")


@query(
    "P03_rename",
    sql("ord", "SELECT order_date AS day, count(order_id) AS orders, CAST(sum(amount) AS DOUBLE) AS spend FROM ord GROUP BY 1"),
)
def p03(shop):
    totals = shop.orders.groupBy("order_date").agg(
        F.count("order_id").alias("orders"), as_double(money_sum("order_value")).alias("spend")
    )
    return totals.withColumnRenamed("order_date", "day")


@query("P04_derived_ratio", sql("rfm", "SELECT customer_id, discount_rate, order_frequency FROM rfm"))
def p04(shop):
    table = features.rfm(shop.orders, horizon(shop.orders))
    return table.select("customer_id", "discount_rate", "order_frequency")


@query(
    "P05_line_revenue",
    sql("ord item", "SELECT order_id, category, CAST(price * quantity AS DOUBLE) AS revenue FROM item JOIN ord USING (order_id)"),
)
def p05(shop):
    table = overview.line_revenue(shop.orders, shop.order_items)
    return table.select("order_id", "category", (F.col("revenue_cents") / 100).alias("revenue"))


@query("P06_cutoff", sql("ord span", "SELECT min(order_date) AS first_date, max(max_date) AS max_date, max(cutoff) AS cutoff FROM ord, span"))
def p06(shop):
    span = horizon(shop.orders)
    first = shop.orders.agg(F.min("order_date").alias("first_date"))
    return first.select("first_date", span.max_date.alias("max_date"), span.cutoff.alias("cutoff"))


@query(
    "P06_cutoff_from_footers",
    sql("ord span", "SELECT max(max_date) AS max_date, max(cutoff) AS cutoff, count(*) FILTER (order_date <= cutoff) AS seen FROM ord, span"),
)
def p06_footers(shop):
    spark = shop.orders.sparkSession
    path = sinks.write_result(shop.orders, scratch_path(spark, "orders"), "parquet")
    placed = spark.read.parquet(path)
    span = horizon(placed, as_of=last_date_in_files(spark, path))
    return placed.agg(span.max_date.alias("max_date"), span.cutoff.alias("cutoff"), F.count_if(span.seen()).alias("seen"))


@query("P07_observation_filter", sql("hist", f"SELECT {ORDER_COLUMNS} FROM hist"))
def p07(shop):
    return observed(shop.orders, horizon(shop.orders))


@query("P08_outcome_filter", sql("fut", f"SELECT {ORDER_COLUMNS} FROM fut"))
def p08(shop):
    return outcome(shop.orders, horizon(shop.orders))


@query("P09_eligibility", sql("elig", "SELECT * FROM elig"))
def p09(shop):
    return eligible(shop.customers, horizon(shop.orders))


def with_history(shop, span):
    return eligible(shop.customers, span).join(features.rfm(shop.orders, span), "customer_id", "left")


@query(
    "P10_fill_constant",
    sql(
        "elig rfm",
        """SELECT customer_id, coalesce(total_orders, 0) AS total_orders, coalesce(total_spend, 0) AS total_spend,
           coalesce(avg_order_value, 0) AS avg_order_value, coalesce(discount_rate, 0) AS discount_rate,
           coalesce(order_frequency, 0) AS order_frequency, tenure_days, discount_orders
        FROM elig LEFT JOIN rfm USING (customer_id)""",
    ),
)
def p10(shop):
    span = horizon(shop.orders)
    return features.fill_missing(with_history(shop, span), span).select(
        "customer_id",
        "total_orders",
        "total_spend",
        "avg_order_value",
        "discount_rate",
        "order_frequency",
        "tenure_days",
        "discount_orders",
    )


@query("P11_fill_expression", sql("feat", "SELECT customer_id, recency_days FROM feat"))
def p11(shop):
    span = horizon(shop.orders)
    return features.fill_missing(with_history(shop, span), span).select("customer_id", "recency_days")


@query(
    "P13_boolean_to_int",
    sql("ord", "SELECT order_id, CAST(order_value >= 250000 AS INTEGER) AS is_large FROM ord"),
)
def p13(shop):
    return shop.orders.select("order_id", (F.col("order_value") >= 250000).cast("int").alias("is_large"))


# ---- joins ----------------------------------------------------------------------------------


@query(
    "J01_left_join",
    sql(
        "cust rfm diversity payment",
        """SELECT customer_id, signup_date, total_orders, total_spend, category_diversity, preferred_payment
        FROM cust LEFT JOIN rfm USING (customer_id) LEFT JOIN diversity USING (customer_id)
             LEFT JOIN payment USING (customer_id)""",
    ),
)
def j01(shop):
    span = horizon(shop.orders)
    return (
        shop.customers.join(features.rfm(shop.orders, span), "customer_id", "left")
        .join(features.category_diversity(shop.orders, shop.order_items, span), "customer_id", "left")
        .join(features.preferred_payment(shop.orders, span), "customer_id", "left")
        .select("customer_id", "signup_date", "total_orders", "total_spend", "category_diversity", "preferred_payment")
    )


@query(
    "J02_orders_items",
    sql("hist item", "SELECT order_id, customer_id, category, quantity FROM hist JOIN item USING (order_id)"),
)
def j02(shop):
    placed = observed(shop.orders, horizon(shop.orders)).select("order_id", "customer_id")
    return placed.join(shop.order_items, "order_id").select("order_id", "customer_id", "category", "quantity")


@query(
    "J03_orders_signup",
    sql("ord cust", "SELECT order_id, customer_id, order_date, signup_date FROM ord JOIN cust USING (customer_id)"),
)
def j03(shop):
    signups = shop.customers.select("customer_id", "signup_date")
    return shop.orders.select("order_id", "customer_id", "order_date").join(signups, "customer_id")


@query("J04_membership_flag", sql("feat", "SELECT customer_id, churned FROM feat"))
def j04(shop):
    return labels.churn_labels(shop.customers, shop.orders, horizon(shop.orders))


@query("J04_membership_in", sql("elig fut", "SELECT * FROM elig WHERE customer_id IN (SELECT customer_id FROM fut)"))
def j04_in(shop):
    return labels.returning(shop.customers, shop.orders, horizon(shop.orders))


@query(
    "J04_membership_not_in",
    sql("elig fut", "SELECT * FROM elig WHERE customer_id NOT IN (SELECT customer_id FROM fut)"),
)
def j04_not_in(shop):
    return labels.lost(shop.customers, shop.orders, horizon(shop.orders))


@query("J05_divide_by_size", sql("retained", "SELECT cohort_month, cohort_index, retention FROM retained"))
def j05(shop):
    return cohorts.retention(cells(shop)).select("cohort_month", "cohort_index", "retention")


# ---- aggregates -----------------------------------------------------------------------------


@query("A01_rfm", sql("rfm", "SELECT * FROM rfm"))
def a01(shop):
    return features.rfm(shop.orders, horizon(shop.orders))


@query("A02_category_diversity", sql("diversity", "SELECT * FROM diversity"))
def a02(shop):
    return features.category_diversity(shop.orders, shop.order_items, horizon(shop.orders))


@query("A03_preferred_payment", sql("payment", "SELECT * FROM payment"))
def a03(shop):
    return features.preferred_payment(shop.orders, horizon(shop.orders))


@query("A04_channel_mix", sql("cust", 'SELECT acquisition_channel AS channel, count(*) AS "count" FROM cust GROUP BY 1'))
def a04_channel(shop):
    return overview.mix(shop.customers, "acquisition_channel", "channel")


@query("A04_payment_mix", sql("ord", 'SELECT payment_method AS method, count(*) AS "count" FROM ord GROUP BY 1'))
def a04_payment(shop):
    return overview.mix(shop.orders, "payment_method", "method")


KPI_SQL = """
    SELECT (SELECT count(*) FROM cust) AS total_customers, count(*) AS total_orders,
           CAST(sum(amount) AS DOUBLE) AS total_revenue,
           CAST(sum(amount) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avg_order_value FROM ord"""


@query("A05_kpis", sql("cust ord", KPI_SQL))
def a05(shop):
    return overview.kpis(shop.customers, shop.orders)


CATEGORY_SQL = """
    SELECT category, CAST(sum(price * quantity) AS DOUBLE) AS revenue
    FROM item JOIN ord USING (order_id) GROUP BY category"""


@query("A06_revenue_by_category", sql("ord item", CATEGORY_SQL))
def a06(shop):
    return overview.revenue_by_category(shop.orders, shop.order_items)


MONTH_SQL = """
    SELECT strftime(order_date, '%Y-%m') AS month, CAST(sum(amount) AS DOUBLE) AS order_value
    FROM ord GROUP BY 1"""


@query("A07_monthly_revenue", sql("ord", MONTH_SQL))
def a07(shop):
    return overview.revenue_by_month(shop.orders)


@query("A08_future_buyers", sql("fut", "SELECT DISTINCT customer_id FROM fut"))
def a08(shop):
    return labels.future_buyers(shop.orders, horizon(shop.orders))


@query(
    "A09_future_spend",
    sql("fut", "SELECT customer_id, CAST(sum(amount) AS DOUBLE) AS future_90d_spend FROM fut GROUP BY 1"),
)
def a09(shop):
    spent = outcome(shop.orders, horizon(shop.orders)).groupBy("customer_id")
    return spent.agg(as_double(money_sum("order_value")).alias("future_90d_spend"))


def class_labels(shop):
    return labels.churn_labels(shop.customers, shop.orders, horizon(shop.orders))


@query(
    "A10_churn_rate",
    sql("feat", "SELECT count(*) AS customers, CAST(sum(churned) AS DOUBLE) / count(*) AS positive_rate FROM feat"),
)
def a10(shop):
    return labels.class_summary(class_labels(shop)).select("customers", "positive_rate")


@query(
    "A11_class_balance",
    sql(
        "feat",
        """SELECT count(*) FILTER (churned = 0) AS negatives, count(*) FILTER (churned = 1) AS positives,
           CAST(count(*) FILTER (churned = 0) AS DOUBLE) / nullif(count(*) FILTER (churned = 1), 0) AS balance,
           CAST(count(*) FILTER (churned = 0) AS DOUBLE) / greatest(count(*) FILTER (churned = 1), 1)
             AS balance_guarded FROM feat""",
    ),
)
def a11(shop):
    table = labels.class_summary(class_labels(shop))
    return table.select("negatives", "positives", "balance", "balance_guarded")


@query("A12_cohort_active", sql("cohort_cell", "SELECT cohort_month, cohort_index, active_customers FROM cohort_cell"))
def a12(shop):
    return cells(shop).select("cohort_month", "cohort_index", "active_customers")


@query("A13_cohort_size", sql("cohort_size", "SELECT * FROM cohort_size"))
def a13(shop):
    return cells(shop).select("cohort_month", "cohort_size").distinct()


@query(
    "A14_cohort_revenue",
    sql("cohort_cell", "SELECT cohort_month, cohort_index, CAST(amount AS DOUBLE) AS revenue FROM cohort_cell"),
)
def a14(shop):
    return cells(shop).select("cohort_month", "cohort_index", as_double("revenue").alias("revenue"))


@query(
    "A15_arm_spread",
    sql(
        "visit",
        """SELECT experiment_id, variant, avg(converted) AS conversion_rate,
           round(avg(order_value), 6) AS aov,
           round(stddev_pop(order_value), 9) AS aov_std,
           round(stddev_pop(order_value) / sqrt(count(order_value)), 9) AS aov_se
        FROM visit GROUP BY 1, 2""",
    ),
)
def a15(spark, folder):
    return experiment.arms(star.visits(spark, folder)).select(
        "experiment_id",
        "variant",
        "conversion_rate",
        F.round("aov", 6).alias("aov"),
        F.round("aov_std", 9).alias("aov_std"),
        F.round("aov_se", 9).alias("aov_se"),
    )


# ---- windows, sort, top-k -------------------------------------------------------------------


@query("W01_running_revenue", sql("cumulated", "SELECT cohort_month, cohort_index, cumulative_revenue FROM cumulated"))
def w01(shop):
    return cohorts.cumulative_revenue(cells(shop)).select("cohort_month", "cohort_index", "cumulative_revenue")


@query(
    "W04_top_row_per_group",
    sql(
        "ord",
        """SELECT customer_id, order_id, order_value
        FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY order_value DESC, order_id) AS rn FROM ord)
        WHERE rn = 1""",
    ),
)
def w04(shop):
    orders = shop.orders.select("customer_id", "order_id", "order_value")
    return reshape.best_row(orders, "order_value", "order_id", by=["customer_id"])


@query("O01_sort_desc", sql("ord item", CATEGORY_SQL + " ORDER BY revenue DESC, category"))
def o01(shop):
    return overview.revenue_by_category(shop.orders, shop.order_items)


FIRST_SQL = """
    SELECT {columns} FROM {source}
    WHERE cohort_month IN (SELECT DISTINCT cohort_month FROM {source} ORDER BY 1 LIMIT {rows})"""


@query(
    "O04_first_cohorts",
    sql(
        "retained",
        FIRST_SQL.format(columns="cohort_month, cohort_index, retention", source="retained", rows=15)
        + " AND cohort_index IN (SELECT DISTINCT cohort_index FROM retained ORDER BY 1 LIMIT 13)",
    ),
)
def o04(shop):
    table = cohorts.retention(cells(shop)).select("cohort_month", "cohort_index", "retention")
    corner = reshape.first_labels(table, cohort_month=15, cohort_index=13)
    return corner.select("cohort_month", "cohort_index", "retention")


# ---- reshape --------------------------------------------------------------------------------


@query("R01_pivot", sql("retained", lines_sql("retained", "active_customers")))
def r01(shop):
    return lines(reshape.to_matrix(settle(cells(shop), "cells"), "cohort_month", "cohort_index", "active_customers"))


@query(
    "R02_melt",
    sql(
        "cumulated",
        """SELECT c.cohort_month, CAST(m.i AS VARCHAR) AS months_since_signup, v.avg_cumulative_revenue AS cumulative_revenue
        FROM (SELECT DISTINCT cohort_month FROM cumulated ORDER BY 1 LIMIT 8) c
        CROSS JOIN (SELECT DISTINCT cohort_index AS i FROM cumulated WHERE cohort_month IN
                      (SELECT DISTINCT cohort_month FROM cumulated ORDER BY 1 LIMIT 8)) m
        LEFT JOIN cumulated v ON v.cohort_month = c.cohort_month AND v.cohort_index = m.i""",
    ),
)
def r02(shop):
    table = settle(reshape.first_labels(cohorts.cumulative_revenue(cells(shop)), cohort_month=8), "corner")
    matrix = reshape.to_matrix(table, "cohort_month", "cohort_index", "avg_cumulative_revenue")
    return reshape.to_long(matrix, "cohort_month", "months_since_signup", "cumulative_revenue")


# ---- scalar functions -----------------------------------------------------------------------


@query(
    "F01_day_difference",
    sql("ord cust", "SELECT order_id, CAST(order_date - signup_date AS INTEGER) AS days FROM ord JOIN cust USING (customer_id)"),
)
def f01(shop):
    joined = shop.orders.join(shop.customers, "customer_id")
    return joined.select("order_id", day_count("order_date", "signup_date").alias("days"))


@query("F02_date_minus_days", sql("ord", "SELECT order_id, order_date - 90 AS window_start FROM ord"))
def f02(shop):
    return shop.orders.select("order_id", F.date_sub("order_date", 90).alias("window_start"))


@query(
    "F03_month_truncation",
    sql("cohort_order", "SELECT order_id, cohort_month, order_month FROM cohort_order"),
)
def f03(shop):
    return cohorts.signup_cohorts(shop.orders, shop.customers).select("order_id", "cohort_month", "order_month")


@query("F04_month_difference", sql("cohort_order", "SELECT order_id, cohort_index FROM cohort_order"))
def f04(shop):
    joined = shop.orders.join(shop.customers, "customer_id")
    return joined.select("order_id", months_between("order_date", "signup_date").alias("cohort_index"))


@query("F05_month_label", sql("ord", "SELECT order_id, strftime(order_date, '%Y-%m') AS month FROM ord"))
def f05(shop):
    return shop.orders.select("order_id", month_label(month_of("order_date")).alias("month"))


@query(
    "F06_arcsine_root",
    sql(
        "visit",
        """SELECT experiment_id, round(asin(sqrt(avg(converted))), 9) AS angle FROM visit GROUP BY 1""",
    ),
)
def f06(spark, folder):
    rates = star.visits(spark, folder).groupBy("experiment_id").agg(F.avg("converted").alias("rate"))
    return rates.select("experiment_id", F.round(F.asin(F.sqrt("rate")), 9).alias("angle"))


@query(
    "F07_ceil_round",
    sql(
        "ord",
        """SELECT order_id, CAST(ceil(order_value / 1000) AS BIGINT) AS thousands_up,
           round(order_value / 7, 3) AS weekly FROM ord""",
    ),
)
def f07(shop):
    return shop.orders.select(
        "order_id",
        F.ceil(F.col("order_value") / 1000).alias("thousands_up"),
        F.round(F.col("order_value") / 7, 3).alias("weekly"),
    )


@query("F08_greatest", sql("feat", "SELECT customer_id, greatest(total_orders, 1) AS orders_or_one FROM feat"))
def f08(shop):
    table = features.fill_missing(with_history(shop, horizon(shop.orders)), horizon(shop.orders))
    return table.select("customer_id", F.greatest("total_orders", F.lit(1)).alias("orders_or_one"))


@query(
    "F09_text_formats",
    sql(
        "ord",
        """SELECT discount_applied, printf('%.2f%%', 100.0 * count(*) / (SELECT count(*) FROM ord)) AS share,
           format('{:,}', count(*)) AS orders, 'Rs.' || format('{:,.2f}', CAST(sum(amount) AS DOUBLE)) AS revenue
        FROM ord GROUP BY 1""",
    ),
)
def f09(shop):
    everything = shop.orders.agg(F.count(F.lit(1)).alias("n")).scalar()
    groups = shop.orders.groupBy("discount_applied").agg(
        F.count(F.lit(1)).alias("n"), money_sum("order_value").alias("amount")
    )
    return groups.select(
        "discount_applied",
        percent(ratio("n", everything)).alias("share"),
        thousands("n").alias("orders"),
        rupees("amount").alias("revenue"),
    )


@query("F10_to_date", sql("ord", "SELECT order_id, order_date FROM ord"))
def f10(shop):
    text = shop.orders.select("order_id", F.col("order_date").cast("string").alias("day"))
    return text.select("order_id", F.to_date("day", "yyyy-MM-dd").alias("order_date"))


@query(
    "R03_one_hot",
    sql(
        "feat",
        """SELECT customer_id, """
        + ", ".join(
            f"""CAST(acquisition_channel = lv[{i}] AS INTEGER) AS channel_{i}""" for i in range(2, 6)
        )
        + """, CAST(gender = 'M' AS INTEGER) AS gender_2
        FROM feat, (SELECT list(DISTINCT acquisition_channel ORDER BY acquisition_channel) AS lv FROM feat)""",
    ),
)
def r03(shop):
    from custoria.operators.matrix import category_levels, dummy_columns

    table = eligible(shop.customers, horizon(shop.orders))
    levels = category_levels(table, ("acquisition_channel", "gender"))
    columns = dummy_columns(levels)
    names = {
        f"{column}_{level}": f"{short}_{place}"
        for column, short in (("acquisition_channel", "channel"), ("gender", "gender"))
        for place, level in enumerate(levels[column], start=1)
    }
    return table.select("customer_id", *[value.alias(names[name]) for name, value in columns.items()])


@query(
    "R03_wide_matrix",
    sql(
        "ord",
        """SELECT 'discount_applied' AS feature, CAST(sum(discount_applied) AS DOUBLE) AS total FROM ord
        UNION ALL SELECT 'order_date_' || strftime(order_date, '%Y-%m-%d'), CAST(count(*) AS DOUBLE) FROM ord
                  WHERE order_date > (SELECT min(order_date) FROM ord) GROUP BY 1
        UNION ALL SELECT 'payment_method_' || payment_method, CAST(count(*) AS DOUBLE) FROM ord
                  WHERE payment_method > (SELECT min(payment_method) FROM ord) GROUP BY 1""",
    ),
)
def r03_wide(shop):
    """Column sums of a matrix with a column per order date."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    from custoria.operators.matrix import Design

    placed = settle(shop.orders, "orders")
    design = Design.fit(placed, ("discount_applied",), ("order_date", "payment_method"))
    sums = design.assemble(placed, ["order_id"]).agg(Summarizer.sum(F.col("features")).alias("v"))
    each = sums.select(F.posexplode(vector_to_array("v")).alias("place", "total"))
    return design.name_table(placed.sparkSession).join(each, "place").select("feature", "total")
