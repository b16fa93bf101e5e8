"""Declared schemas of the raw tables.

The source files carry no types; instead of inferring them (an extra pass
that is not stable between files) every raw table has a declared
``StructType``.  Money is ``DECIMAL(18,2)`` so sums are exact, zip prefixes
are strings so leading zeros survive, timestamps arrive as text and are
cast by the staging layer.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

ORDERS = T.StructType(
    [
        T.StructField("order_id", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("order_status", T.StringType()),
        T.StructField("order_purchase_timestamp", T.StringType()),
        T.StructField("order_approved_at", T.StringType()),
        T.StructField("order_delivered_carrier_date", T.StringType()),
        T.StructField("order_delivered_customer_date", T.StringType()),
        T.StructField("order_estimated_delivery_date", T.StringType()),
    ]
)

ORDER_ITEMS = T.StructType(
    [
        T.StructField("order_id", T.StringType()),
        T.StructField("order_item_id", T.IntegerType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("seller_id", T.StringType()),
        T.StructField("shipping_limit_date", T.StringType()),
        T.StructField("price", MONEY),
        T.StructField("freight_value", MONEY),
    ]
)

CUSTOMERS = T.StructType(
    [
        T.StructField("customer_id", T.StringType()),
        T.StructField("customer_unique_id", T.StringType()),
        T.StructField("customer_zip_code_prefix", T.StringType()),
        T.StructField("customer_city", T.StringType()),
        T.StructField("customer_state", T.StringType()),
    ]
)

PRODUCTS = T.StructType(
    [
        T.StructField("product_id", T.StringType()),
        T.StructField("product_category_name", T.StringType()),
        # the misspelled column names are the source's own
        T.StructField("product_name_lenght", T.DoubleType()),
        T.StructField("product_description_lenght", T.DoubleType()),
        T.StructField("product_photos_qty", T.DoubleType()),
        T.StructField("product_weight_g", T.DoubleType()),
        T.StructField("product_length_cm", T.DoubleType()),
        T.StructField("product_height_cm", T.DoubleType()),
        T.StructField("product_width_cm", T.DoubleType()),
    ]
)

SELLERS = T.StructType(
    [
        T.StructField("seller_id", T.StringType()),
        T.StructField("seller_zip_code_prefix", T.StringType()),
        T.StructField("seller_city", T.StringType()),
        T.StructField("seller_state", T.StringType()),
    ]
)

CATEGORY_TRANSLATION = T.StructType(
    [
        T.StructField("product_category_name", T.StringType()),
        T.StructField("product_category_name_english", T.StringType()),
    ]
)

ORDER_PAYMENTS = T.StructType(
    [
        T.StructField("order_id", T.StringType()),
        T.StructField("payment_sequential", T.IntegerType()),
        T.StructField("payment_type", T.StringType()),
        T.StructField("payment_installments", T.IntegerType()),
        T.StructField("payment_value", MONEY),
    ]
)

ORDER_REVIEWS = T.StructType(
    [
        T.StructField("review_id", T.StringType()),
        T.StructField("order_id", T.StringType()),
        T.StructField("review_score", T.IntegerType()),
        T.StructField("review_comment_title", T.StringType()),
        T.StructField("review_comment_message", T.StringType()),
        T.StructField("review_creation_date", T.StringType()),
        T.StructField("review_answer_timestamp", T.StringType()),
    ]
)

GEOLOCATION = T.StructType(
    [
        T.StructField("geolocation_zip_code_prefix", T.StringType()),
        T.StructField("geolocation_lat", T.DoubleType()),
        T.StructField("geolocation_lng", T.DoubleType()),
        T.StructField("geolocation_city", T.StringType()),
        T.StructField("geolocation_state", T.StringType()),
    ]
)

# The nine declared raw tables, keyed by table name after file-name normalisation.
RAW_SCHEMAS: dict[str, T.StructType] = {
    "orders": ORDERS,
    "order_items": ORDER_ITEMS,
    "customers": CUSTOMERS,
    "products": PRODUCTS,
    "sellers": SELLERS,
    "order_payments": ORDER_PAYMENTS,
    "order_reviews": ORDER_REVIEWS,
    "product_category_name_translation": CATEGORY_TRANSLATION,
    "geolocation": GEOLOCATION,
}

#: Tables with free text: quoted fields may hold line breaks.
FREE_TEXT_TABLES = frozenset({"order_reviews"})
