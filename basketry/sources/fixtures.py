"""Adapters from the driver's TPC-H-style tables to the raw commerce tables.

The engine's operators consume the nine raw commerce tables.  The test and
benchmark data come as TPC-H-style parquet, so these functions derive the
raw tables from them with plain projections and one join (line items need
the part price).  They are lazy: nothing is read until an action, and the
parquet scans keep column pruning and filter pushdown.

The same definitions are written in DuckDB SQL in ``plans/oracle.py``; the
two must stay in step.
"""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MONEY

# Fixed values shared with the oracle: the status mapping and the category
# translated part types (LARGE is left untranslated on purpose).
TRANSLATED_CATEGORIES = ["STANDARD", "ECONOMY", "MEDIUM", "SMALL"]
PROMO_CATEGORY = "PROMO"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seconds(c) -> F.Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), c)


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders: status from (o_orderstatus, o_orderpriority), purchase time = date + key-derived seconds."""
    o = read_table(spark, sf_dir, "orders")
    status = (
        F.when(F.col("o_orderstatus") == "F", "delivered")
        .when(F.col("o_orderstatus") == "O", "shipped")
        .when(F.col("o_orderpriority") == "5-LOW", "unavailable")
        .when(F.col("o_orderpriority") == "1-URGENT", "canceled")
        .otherwise("processing")
    )
    day = F.col("o_orderdate").cast("timestamp_ntz")
    purchase = day + _seconds((F.col("o_orderkey") * 7919) % 86400)
    approved = purchase + _seconds((F.col("o_orderkey") * 31) % 7200)
    shipped = F.col("o_orderstatus").isin("F", "O")
    return o.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        status.alias("order_status"),
        purchase.alias("order_purchase_timestamp"),
        approved.alias("order_approved_at"),
        F.when(shipped, day + F.expr("INTERVAL 2 DAYS")).alias("order_delivered_carrier_date"),
        F.when(F.col("o_orderstatus") == "F", day + F.expr("INTERVAL 7 DAYS")).alias(
            "order_delivered_customer_date"
        ),
        (day + F.expr("INTERVAL 10 DAYS")).alias("order_estimated_delivery_date"),
    )


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers: two order-level ids per person (customer_unique_id = custkey div 2)."""
    c = read_table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("customer_id"),
        F.expr("c_custkey div 2").alias("customer_unique_id"),
        F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("customer_zip_code_prefix"),
        F.concat(F.lit("city_"), F.col("c_nationkey").cast("string")).alias("customer_city"),
        F.col("c_mktsegment").alias("customer_state"),
    )


def raw_order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_items: lineitem joined to part for the unit price; money as DECIMAL(18,2)."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_tax", "l_shipdate"
    )
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    retail = F.col("p_retailprice").cast(MONEY)
    disc = F.col("l_discount").cast("decimal(4,2)")
    tax = F.col("l_tax").cast("decimal(4,2)")
    return li.join(p, li.l_partkey == p.p_partkey, "inner").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("shipping_limit_date"),
        F.round(retail * (F.lit(1) - disc), 2).cast(MONEY).alias("price"),
        F.round(retail * (disc + tax), 2).cast(MONEY).alias("freight_value"),
    )


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """products: category = p_type with PROMO as missing; sizes from p_size."""
    p = read_table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("product_id"),
        F.nullif(F.col("p_type"), F.lit(PROMO_CATEGORY)).alias("product_category_name"),
        F.length("p_name").cast("double").alias("product_name_lenght"),
        F.length("p_brand").cast("double").alias("product_description_lenght"),
        F.lit(1.0).alias("product_photos_qty"),
        (F.col("p_size") * 100).cast("double").alias("product_weight_g"),
        F.col("p_size").cast("double").alias("product_length_cm"),
        F.lit(10.0).alias("product_height_cm"),
        F.lit(5.0).alias("product_width_cm"),
    )


def raw_category_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translation rows: '<x>' -> '<x> goods' for the translated categories among the part types."""
    p = read_table(spark, sf_dir, "part").where(F.col("p_type").isin(TRANSLATED_CATEGORIES))
    return p.select(
        F.col("p_type").alias("product_category_name"),
        F.concat("p_type", F.lit(" goods")).alias("product_category_name_english"),
    ).distinct()


def raw_order_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_payments: one or two payments per order, which add up to its total price."""
    o = read_table(spark, sf_dir, "orders")
    total = F.col("o_totalprice").cast(MONEY)
    voucher = (total * F.lit(Decimal("0.25"))).cast(MONEY)
    split = F.col("o_orderkey") % 5 == 0
    n = F.explode(F.when(split, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    rows = o.select("o_orderkey", "o_orderpriority", total.alias("total"), voucher.alias("voucher"), split.alias("split"), n.alias("n"))
    kind = F.when(F.col("n") == 2, "voucher").when(F.col("o_orderpriority") == "5-LOW", "boleto").otherwise("credit_card")
    value = F.when(F.col("n") == 2, F.col("voucher")).when(F.col("split"), F.col("total") - F.col("voucher")).otherwise(F.col("total"))
    return rows.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("n").alias("payment_sequential"),
        kind.alias("payment_type"),
        (F.col("o_orderkey") % 12 + 1).cast("int").alias("payment_installments"),
        value.cast(MONEY).alias("payment_value"),
    )


def raw_order_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_reviews: one per order; messages hold quotes, commas and line breaks."""
    o = read_table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("timestamp_ntz")
    message = F.concat(F.lit('the "'), F.col("o_orderpriority"), F.lit('" order,\nnumber '), key.cast("string"), F.lit(', came'))
    return o.select(
        F.concat(F.lit("r"), key.cast("string")).alias("review_id"),
        key.alias("order_id"),
        (key % 5 + 1).cast("int").alias("review_score"),
        F.when(key % 3 == 0, F.concat(F.lit("title, "), F.col("o_orderstatus"))).alias("review_comment_title"),
        F.when(key % 4 != 0, message).alias("review_comment_message"),
        (day + F.expr("INTERVAL 8 DAYS")).alias("review_creation_date"),
        (day + F.expr("INTERVAL 9 DAYS")).alias("review_answer_timestamp"),
    )


def raw_geolocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """geolocation: one point per customer, at its nation's zip prefix."""
    c = read_table(spark, sf_dir, "customer")
    return c.select(
        F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("geolocation_zip_code_prefix"),
        (F.col("c_custkey") % 720 / 4.0 - 90.0).alias("geolocation_lat"),
        (F.col("c_custkey") % 1440 / 4.0 - 180.0).alias("geolocation_lng"),
        F.concat(F.lit("city_"), F.col("c_nationkey").cast("string")).alias("geolocation_city"),
        F.col("c_mktsegment").alias("geolocation_state"),
    )


def raw_sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sellers: zip from the nation key, city from the supplier name."""
    s = read_table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("seller_id"),
        F.lpad(F.col("s_nationkey").cast("string"), 5, "0").alias("seller_zip_code_prefix"),
        F.col("s_name").alias("seller_city"),
        F.col("s_nationkey").cast("string").alias("seller_state"),
    )


def purchase_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase events as an order mapping (order_id, purchase_at, customer_unique_id).

    Event times have sub-day gaps, which the order adapter lacks; they feed the
    technical-split metrics.
    """
    e = read_table(spark, sf_dir, "events")
    return e.where(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("order_id"),
        F.col("ts").cast("timestamp_ntz").alias("purchase_at"),
        F.col("user_id").alias("customer_unique_id"),
    )


class RawTables(Mapping):
    """The raw inputs keyed like the declared raw tables, each built on first use."""

    _BUILDERS = {
        "orders": raw_orders,
        "order_items": raw_order_items,
        "customers": raw_customers,
        "products": raw_products,
        "sellers": raw_sellers,
        "product_category_name_translation": raw_category_translation,
        "order_payments": raw_order_payments,
        "order_reviews": raw_order_reviews,
        "geolocation": raw_geolocation,
    }

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._sf, self._built = spark, sf_dir, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._BUILDERS[name](self._spark, self._sf)
        return self._built[name]

    def __iter__(self):
        return iter(self._BUILDERS)

    def __len__(self) -> int:
        return len(self._BUILDERS)


def raw_tables(spark: SparkSession, sf_dir: str) -> RawTables:
    """All raw inputs the models read (lazy mapping)."""
    return RawTables(spark, sf_dir)


def adapter_schemas():
    """Declared raw schemas as the adapters produce them: numeric (bigint) keys.

    The production schemas keep keys as strings; the driver's tables use
    integer keys, so files written from the adapters are read back with these.
    """
    from pyspark.sql import types as T

    from ..schemas import RAW_SCHEMAS

    keys = {"order_id", "customer_id", "customer_unique_id", "product_id", "seller_id"}
    out = {}
    for name, st in RAW_SCHEMAS.items():
        out[name] = T.StructType(
            [T.StructField(f.name, T.LongType(), f.nullable) if f.name in keys else f for f in st.fields]
        )
    return out
