"""The user-level tables: features, labels, sweep, spend, cohorts, overview."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, sql
from checks.relational import CATEGORY_SQL, KPI_SQL, MONTH_SQL, MILLION, cells, lines, lines_sql
from custoria.operators import cohorts, features, labels, reshape
from custoria.operators.horizon import horizon, last_date
from custoria.plans import reports
from custoria.session import scratch_path
from custoria.sources.layout import write_layout
from custoria.sources.reuse import settle

FEATURE_COLUMNS = """customer_id, signup_date, city, age, gender, acquisition_channel, total_orders, total_spend,
    avg_order_value, last_order_date, first_order_date, discount_orders, recency_days, tenure_days, discount_rate,
    order_frequency, category_diversity, preferred_payment, churned"""


@query("Q01_customer_features", sql("feat", f"SELECT {FEATURE_COLUMNS} FROM feat"))
def q01(shop):
    span = horizon(shop.orders, as_of=last_date(shop.orders))
    return features.churn_features(shop.customers, shop.orders, shop.order_items, span)


@query("Q01_customer_features_short", sql("feat", "SELECT * EXCLUDE (preferred_payment) FROM feat"))
def q01_short(shop):
    span = horizon(shop.orders, as_of=last_date(shop.orders))
    return features.churn_features(shop.customers, shop.orders, shop.order_items, span, payment=False)


def rate_sql(days: int) -> str:
    last = "(SELECT max(order_date) FROM ord)"
    return f"""
    SELECT CAST({days} AS INTEGER) AS window_days, count(*) AS eligible,
           count(*) FILTER (customer_id NOT IN (
             SELECT customer_id FROM ord WHERE order_date > {last} - {days})) AS churned
    FROM cust WHERE signup_date <= {last} - {days}"""


RATE = "SELECT window_days, eligible, churned, CAST(churned AS DOUBLE) / eligible AS churn_rate FROM"


@query("Q01_customer_features_buckets", sql("feat", f"SELECT {FEATURE_COLUMNS} FROM feat"))
def q01_buckets(shop):
    """The same table over a layout in buckets of customers."""
    saved = write_layout(shop, scratch_path(shop.orders.sparkSession, "layout"))
    span = horizon(saved.orders, as_of=last_date(saved.orders))
    return features.churn_features(saved.customers, saved.orders, saved.order_items, span)


@query("Q02_churn_rate", sql("cust ord", f"{RATE} ({rate_sql(90)})"))
def q02(shop):
    table = labels.class_summary(labels.churn_labels(shop.customers, shop.orders, horizon(shop.orders, 90, last_date(shop.orders))))
    return table.select(
        F.lit(90).alias("window_days"),
        F.col("customers").alias("eligible"),
        F.col("positives").alias("churned"),
        F.col("positive_rate").alias("churn_rate"),
    )


@query(
    "Q03_churn_sweep",
    sql("cust ord", f"{RATE} ({' UNION ALL '.join(rate_sql(days) for days in labels.SWEEP_DAYS)})"),
)
def q03(shop):
    return labels.churn_sweep(shop.customers, shop.orders)


@query("Q04_spend_features", sql("clv", "SELECT * FROM clv"))
def q04(shop):
    return features.spend_features(shop.customers, shop.orders, horizon(shop.orders, as_of=last_date(shop.orders)))


@query("Q05_retention", sql("retained", "SELECT * FROM retained"))
def q05(shop):
    return cohorts.retention(cells(shop))


@query("Q05_retention_matrix", sql("retained", lines_sql("retained", "retention", scale=MILLION)))
def q05_wide(shop):
    table = settle(cohorts.retention(cells(shop)), "retention")
    return lines(reshape.to_matrix(table, "cohort_month", "cohort_index", "retention"), MILLION)


@query("Q06_cumulative_revenue", sql("cumulated", "SELECT * FROM cumulated"))
def q06(shop):
    return cohorts.cumulative_revenue(cells(shop))


@query("Q06_cumulative_revenue_matrix", sql("cumulated", lines_sql("cumulated", "avg_cumulative_revenue", scale=MILLION)))
def q06_wide(shop):
    table = settle(cohorts.cumulative_revenue(cells(shop)), "revenue")
    return lines(reshape.to_matrix(table, "cohort_month", "cohort_index", "avg_cumulative_revenue"), MILLION)


@query(
    "Q07_overview",
    sql(
        "cust ord item",
        f"""SELECT 'kpi' AS section, 'total_customers' AS label, CAST(total_customers AS DOUBLE) AS value FROM ({KPI_SQL})
        UNION ALL SELECT 'kpi', 'total_orders', CAST(total_orders AS DOUBLE) FROM ({KPI_SQL})
        UNION ALL SELECT 'kpi', 'total_revenue', total_revenue FROM ({KPI_SQL})
        UNION ALL SELECT 'kpi', 'avg_order_value', avg_order_value FROM ({KPI_SQL})
        UNION ALL SELECT 'revenue_by_category', category, revenue FROM ({CATEGORY_SQL})
        UNION ALL SELECT 'revenue_by_month', month, order_value FROM ({MONTH_SQL})
        UNION ALL SELECT 'customers_by_channel', acquisition_channel, CAST(count(*) AS DOUBLE) FROM cust GROUP BY 2
        UNION ALL SELECT 'orders_by_payment', payment_method, CAST(count(*) AS DOUBLE) FROM ord GROUP BY 2""",
    ),
)
def q07(shop):
    return reports.overview_page(shop)
