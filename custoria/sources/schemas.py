"""Fixed column contracts of the input tables."""

from pyspark.sql import types as T


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


CUSTOMERS = _struct(
    customer_id=T.LongType(),
    signup_date=T.DateType(),
    city=T.StringType(),
    age=T.IntegerType(),
    gender=T.StringType(),
    acquisition_channel=T.StringType(),
)

ORDERS = _struct(
    order_id=T.LongType(),
    customer_id=T.LongType(),
    order_date=T.DateType(),
    order_value=T.DoubleType(),
    discount_applied=T.IntegerType(),
    payment_method=T.StringType(),
)

ORDER_ITEMS = _struct(
    order_item_id=T.LongType(),
    order_id=T.LongType(),
    category=T.StringType(),
    quantity=T.IntegerType(),
    item_price=T.DoubleType(),
)

VISITS = _struct(
    experiment_id=T.StringType(),
    variant=T.StringType(),
    converted=T.IntegerType(),
    order_value=T.DoubleType(),
)

TABLES = {"customers": CUSTOMERS, "orders": ORDERS, "order_items": ORDER_ITEMS, "visits": VISITS}
