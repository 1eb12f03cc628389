"""Small inline tables with the contract's types."""

import datetime as dt

from custoria.sources.schemas import CUSTOMERS, ORDERS, VISITS

ITEMS = "order_id bigint, category string, quantity int, item_price double"


def day(text):
    return dt.date.fromisoformat(text) if text else None


def customers(spark, *rows):
    """(customer_id, signup) each."""
    data = [(key, day(signup), "Pune", 30, "F", "Email") for key, signup in rows]
    return spark.createDataFrame(data, CUSTOMERS)


def orders(spark, *rows):
    """(order_id, customer_id, date, value, payment, discount) each; trailing parts may be left out."""
    data = []
    for row in rows:
        order, customer, date, value, payment, discount = (*row, *("Card", 0)[len(row) - 4 :])
        data.append((order, customer, day(date), float(value), discount, payment))
    return spark.createDataFrame(data, ORDERS)


def items(spark, *rows):
    return spark.createDataFrame([(o, c, q, float(p)) for o, c, q, p in rows], ITEMS)


def visits(spark, **experiments):
    """Per experiment: (control n, control conversions, its values), the same for treatment."""
    data = []
    for name, arms in experiments.items():
        for variant, (n, conversions, values) in zip(("control", "treatment"), arms):
            for i in range(n):
                value = float(values[i % len(values)]) if i < conversions else None
                data.append((name, variant, int(i < conversions), value))
    return spark.createDataFrame(data, VISITS)
