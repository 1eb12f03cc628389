"""Registration of queries and composition of their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from custoria.session import tune
from custoria.sources import star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}

# name -> (names it builds on, SELECT text); the views the twins share.
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, *needs: str, text: str) -> None:
    VIEWS[name] = (needs, text)


def sql(needs: str, text: str) -> str:
    """`text` with the named views, and those below them, in front as common table expressions."""
    order: list[str] = []

    def add(name: str) -> None:
        for below in VIEWS[name][0]:
            add(below)
        if name not in order:
            order.append(name)

    for name in needs.split():
        add(name)
    parts = ",\n".join(f"{name} AS ({VIEWS[name][1]})" for name in order)
    return f"WITH {parts}\n{text}"


def query(name: str, twin: str | None = None):
    """Register a function of a loaded `Shop` (or of session and folder if it wants both)."""

    def register(function):
        @wraps(function)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            tune(spark)
            if function.__code__.co_argcount == 2:
                return function(spark, folder)
            return function(star.shop(spark, folder))

        QUERIES[name] = run
        if twin:
            TWINS[name] = twin
        return run

    return register


view(
    "cust",
    text="""
    SELECT c_custkey AS customer_id,
           DATE '1995-01-01' + CAST((c_custkey * 37) % 2400 AS INTEGER) AS signup_date,
           n_name AS city,
           CAST(18 + c_custkey % 47 AS INTEGER) AS age,
           CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
           c_mktsegment AS acquisition_channel
    FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
view(
    "ord",
    "cust",
    text="""
    SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS order_date,
           CAST(o_totalprice AS DECIMAL(18,2)) AS amount, o_totalprice AS order_value,
           CAST(o_orderstatus = 'P' AS INTEGER) AS discount_applied, o_orderpriority AS payment_method
    FROM orders JOIN cust ON o_custkey = cust.customer_id
    WHERE CAST(o_orderdate AS DATE) >= signup_date""",
)
view(
    "item",
    text="""
    SELECT l_orderkey AS order_id, p_type AS category, CAST(l_quantity AS INTEGER) AS quantity,
           p_retailprice AS item_price, CAST(p_retailprice AS DECIMAL(18,2)) AS price
    FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
for _name, _label in (("visit", "strftime(ts, '%Y-%m-%d')"), ("visit_all", "'all'")):
    view(
        _name,
        text=f"""
    SELECT {_label} AS experiment_id,
           CASE WHEN event_id % 2 = 1 THEN 'treatment' ELSE 'control' END AS variant,
           CAST(event_type = 'purchase' AS INTEGER) AS converted,
           CASE WHEN event_type = 'purchase' THEN value END AS order_value
    FROM events""",
    )
view("span", "ord", text="SELECT max(order_date) AS max_date, max(order_date) - 90 AS cutoff FROM ord")
view("hist", "ord", "span", text="SELECT ord.* FROM ord, span WHERE order_date <= cutoff")
view("fut", "ord", "span", text="SELECT ord.* FROM ord, span WHERE order_date > cutoff AND order_date <= max_date")
view("elig", "cust", "span", text="SELECT cust.* FROM cust, span WHERE signup_date <= cutoff")
view(
    "rfm",
    "hist",
    "span",
    text="""
    SELECT customer_id, total_orders, total_spend, avg_order_value, last_order_date, first_order_date,
           discount_orders,
           CAST(cutoff - last_order_date AS INTEGER) AS recency_days,
           CAST(last_order_date - first_order_date AS INTEGER) AS tenure_days,
           CAST(discount_orders AS DOUBLE) / CAST(total_orders AS DOUBLE) AS discount_rate,
           CAST(total_orders AS DOUBLE) / CAST(last_order_date - first_order_date + 1 AS DOUBLE) * 30
             AS order_frequency
    FROM (SELECT customer_id, count(*) AS total_orders, CAST(sum(amount) AS DOUBLE) AS total_spend,
                 CAST(sum(amount) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avg_order_value,
                 max(order_date) AS last_order_date, min(order_date) AS first_order_date,
                 CAST(sum(discount_applied) AS BIGINT) AS discount_orders
          FROM hist GROUP BY customer_id), span""",
)
view(
    "diversity",
    "hist",
    "item",
    text="""
    SELECT customer_id, count(DISTINCT category) AS category_diversity
    FROM hist JOIN item USING (order_id) GROUP BY customer_id""",
)
view(
    "payment",
    "hist",
    text="""
    SELECT customer_id, payment_method AS preferred_payment
    FROM (SELECT customer_id, payment_method,
                 row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, payment_method) AS rn
          FROM hist GROUP BY customer_id, payment_method)
    WHERE rn = 1""",
)
view(
    "feat",
    "elig",
    "rfm",
    "diversity",
    "payment",
    "fut",
    text="""
    SELECT customer_id, signup_date, city, age, gender, acquisition_channel,
           coalesce(total_orders, 0) AS total_orders, coalesce(total_spend, 0) AS total_spend,
           coalesce(avg_order_value, 0) AS avg_order_value, last_order_date, first_order_date,
           discount_orders,
           coalesce(recency_days, CAST(cutoff - signup_date AS INTEGER)) AS recency_days,
           tenure_days, coalesce(discount_rate, 0) AS discount_rate,
           coalesce(order_frequency, 0) AS order_frequency,
           coalesce(category_diversity, 0) AS category_diversity,
           coalesce(preferred_payment, 'None') AS preferred_payment,
           CAST(customer_id NOT IN (SELECT customer_id FROM fut) AS INTEGER) AS churned
    FROM elig LEFT JOIN rfm USING (customer_id) LEFT JOIN diversity USING (customer_id)
         LEFT JOIN payment USING (customer_id), span""",
)
view(
    "clv",
    "elig",
    "rfm",
    "fut",
    text="""
    SELECT customer_id, signup_date, city, age, gender, acquisition_channel,
           coalesce(total_orders, 0) AS total_orders, coalesce(total_spend, 0) AS total_spend,
           coalesce(avg_order_value, 0) AS avg_order_value, last_order_date, first_order_date,
           coalesce(recency_days, CAST(cutoff - signup_date AS INTEGER)) AS recency_days,
           tenure_days, coalesce(order_frequency, 0) AS order_frequency,
           coalesce(future_90d_spend, 0) AS future_90d_spend
    FROM elig LEFT JOIN rfm USING (customer_id)
         LEFT JOIN (SELECT customer_id, CAST(sum(amount) AS DOUBLE) AS future_90d_spend
                    FROM fut GROUP BY customer_id) USING (customer_id), span""",
)
view(
    "cohort_order",
    "ord",
    "cust",
    text="""
    SELECT ord.*, CAST(date_trunc('month', signup_date) AS DATE) AS cohort_month,
           CAST(date_trunc('month', order_date) AS DATE) AS order_month,
           CAST(date_diff('month', date_trunc('month', signup_date), date_trunc('month', order_date))
                AS INTEGER) AS cohort_index
    FROM ord JOIN cust USING (customer_id)""",
)
view(
    "cohort_size",
    "cohort_order",
    text="""
    SELECT cohort_month, count(DISTINCT customer_id) AS cohort_size
    FROM cohort_order GROUP BY cohort_month""",
)
view(
    "cohort_cell",
    "cohort_order",
    "cohort_size",
    text="""
    SELECT cohort_month, cohort_index, count(DISTINCT customer_id) AS active_customers,
           sum(amount) AS amount, any_value(cohort_size) AS cohort_size
    FROM cohort_order JOIN cohort_size USING (cohort_month) GROUP BY cohort_month, cohort_index""",
)
view(
    "retained",
    "cohort_cell",
    text="""
    SELECT cohort_month, cohort_index, active_customers, cohort_size,
           CAST(active_customers AS DOUBLE) / CAST(cohort_size AS DOUBLE) AS retention
    FROM cohort_cell""",
)
view(
    "cumulated",
    "cohort_cell",
    text="""
    SELECT cohort_month, cohort_index, cohort_size, CAST(amount AS DOUBLE) AS revenue,
           CAST(running AS DOUBLE) AS cumulative_revenue,
           CAST(running AS DOUBLE) / CAST(cohort_size AS DOUBLE) AS avg_cumulative_revenue
    FROM (SELECT *, sum(amount) OVER (PARTITION BY cohort_month ORDER BY cohort_index
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM cohort_cell)""",
)
