"""Staging projections: renames, casts and one computed column per raw table.

Each is a lazy ``select``; Catalyst prunes unused columns into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.temporal import to_timestamp_ntz


def stg_category_translate(raw: DataFrame) -> DataFrame:
    """Category translation with Portuguese/English column names."""
    return raw.select(
        F.col("product_category_name").alias("category_name_pt"),
        F.col("product_category_name_english").alias("category_name_en"),
    )


def stg_customer(raw: DataFrame) -> DataFrame:
    """Order-level id (customer_id) and person-level id (customer_unique_id)."""
    return raw.select(
        "customer_id",
        "customer_unique_id",
        F.col("customer_zip_code_prefix").alias("zip_code"),
        "customer_city",
        "customer_state",
    )


def stg_order(raw: DataFrame) -> DataFrame:
    """Five text→timestamp casts with renames."""
    return raw.select(
        "order_id",
        "customer_id",
        "order_status",
        to_timestamp_ntz("order_purchase_timestamp").alias("purchase_at"),
        to_timestamp_ntz("order_approved_at").alias("approved_at"),
        to_timestamp_ntz("order_delivered_carrier_date").alias("delivered_to_carrier_at"),
        to_timestamp_ntz("order_delivered_customer_date").alias("delivered_to_customer_at"),
        to_timestamp_ntz("order_estimated_delivery_date").alias("estimated_delivery_at"),
    )


def stg_order_items(raw: DataFrame) -> DataFrame:
    """Order items with the item total (price + freight)."""
    return raw.select(
        "order_id",
        "order_item_id",
        "product_id",
        "seller_id",
        "price",
        "freight_value",
        (F.col("price") + F.col("freight_value")).alias("total_item_cost"),
    )


def stg_products(raw: DataFrame) -> DataFrame:
    """Products with attribute renames (source misspellings corrected)."""
    return raw.select(
        "product_id",
        "product_category_name",
        F.col("product_name_lenght").alias("name_length"),
        F.col("product_description_lenght").alias("description_length"),
        F.col("product_photos_qty").alias("photos_qty"),
        F.col("product_weight_g").alias("weight_g"),
        F.col("product_length_cm").alias("length_cm"),
        F.col("product_height_cm").alias("height_cm"),
        F.col("product_width_cm").alias("width_cm"),
    )


def stg_sellers(raw: DataFrame) -> DataFrame:
    """Sellers; the city column is read under its real name (seller_city)."""
    return raw.select(
        "seller_id",
        F.col("seller_zip_code_prefix").alias("zip"),
        "seller_city",
        "seller_state",
    )
