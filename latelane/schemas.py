"""The nine input tables: columns the operators read, and their types."""

from __future__ import annotations

from pyspark.sql import types as T

_ID = T.StringType()
_TEXT = T.StringType()
_INT = T.IntegerType()
_REAL = T.DoubleType()
_TIME = T.TimestampNTZType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


# The column names of the published marketplace data set.
TABLES: dict[str, T.StructType] = {
    "customers": _table(customer_id=_ID, customer_zip_code_prefix=_INT, customer_state=_TEXT),
    "geolocation": _table(
        geolocation_zip_code_prefix=_INT, geolocation_lat=_REAL, geolocation_lng=_REAL
    ),
    "items": _table(
        order_id=_ID,
        order_item_id=_INT,
        product_id=_ID,
        seller_id=_ID,
        shipping_limit_date=_TIME,
        price=_REAL,
        freight_value=_REAL,
    ),
    "payments": _table(
        order_id=_ID, payment_type=_TEXT, payment_installments=_INT, payment_value=_REAL
    ),
    "reviews": _table(
        order_id=_ID, review_score=_REAL, review_creation_date=_TIME, review_answer_timestamp=_TIME
    ),
    "orders": _table(
        order_id=_ID,
        customer_id=_ID,
        order_status=_TEXT,
        order_purchase_timestamp=_TIME,
        order_approved_at=_TIME,
        order_delivered_carrier_date=_TIME,
        order_delivered_customer_date=_TIME,
        order_estimated_delivery_date=_TIME,
    ),
    "products": _table(
        product_id=_ID,
        product_category_name=_TEXT,
        product_weight_g=_REAL,
        product_length_cm=_REAL,
        product_height_cm=_REAL,
        product_width_cm=_REAL,
    ),
    "sellers": _table(seller_id=_ID, seller_zip_code_prefix=_INT, seller_state=_TEXT),
    "categories": _table(product_category_name=_TEXT, product_category_name_english=_TEXT),
}

# File stem of each table in the published CSV bundle. A bundle may put
# its own prefix before the stem, so stems are matched at the end of the file name.
CSV_STEMS = {
    "customers": "customers_dataset",
    "geolocation": "geolocation_dataset",
    "items": "order_items_dataset",
    "payments": "order_payments_dataset",
    "reviews": "order_reviews_dataset",
    "orders": "orders_dataset",
    "products": "products_dataset",
    "sellers": "sellers_dataset",
    "categories": "product_category_name_translation",
}

# Columns parsed for their type but never read by an operator; their absence is fine.
OPTIONAL_COLUMNS = {
    "orders": {"order_approved_at", "order_delivered_carrier_date"},
    "items": {"shipping_limit_date"},
    "reviews": {"review_creation_date", "review_answer_timestamp"},
}


def required_columns(table: str) -> list[str]:
    optional = OPTIONAL_COLUMNS.get(table, set())
    return [name for name in TABLES[table].names if name not in optional]
