"""Joins.

No side is measured first: Catalyst broadcasts a side whose size statistics
are under ``spark.sql.autoBroadcastJoinThreshold`` (bytes), adaptive execution
does the same from run-time sizes and splits skewed partitions.  Only one-row
frames (global aggregates) are broadcast by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_small(
    big: DataFrame,
    small: DataFrame,
    on: str | list[str] | Column,
    how: str = "left",
    one_row: bool = False,
) -> DataFrame:
    """Join ``big`` with a presumably small side; its size decides the strategy, in bytes.

    ``one_row=True`` declares that ``small`` is one row by construction (an
    aggregate without grouping).
    """
    return big.join(F.broadcast(small) if one_row else small, on, how)


def with_global(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Every row × a one-row frame (scalar subquery): broadcast nested-loop over one row."""
    return df.crossJoin(F.broadcast(one_row))


def attach_order_totals(orders: DataFrame, totals: DataFrame) -> DataFrame:
    """orders ⟕ per-order totals on order_id (totals are already hashed by order_id)."""
    return orders.join(totals, "order_id", "left")


def attach_translation(df: DataFrame, translation: DataFrame, category_col: str = "product_category_name") -> DataFrame:
    """⟕ category translation on the Portuguese name; translation is a small dimension."""
    t = translation.select("category_name_pt", "category_name_en")
    return join_small(df, t.withColumnRenamed("category_name_pt", category_col), category_col, "left")


def fact_with_person(fct: DataFrame, customers: DataFrame) -> DataFrame:
    """fact ⋈ customer bridge on customer_id (order-level id → person)."""
    return fct.join(customers.select("customer_id", "customer_unique_id"), "customer_id", "inner")


def order_item_product(orders: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """orders ⋈ items ⋈ products (inner, equi)."""
    return orders.join(items, "order_id", "inner").join(products, "product_id", "inner")
