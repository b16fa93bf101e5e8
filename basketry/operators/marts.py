"""The seven marts and their named building blocks.

Each function takes staged DataFrames and returns a DataFrame.  Only product
cost and retention run jobs of their own: they write the frame that all their
steps read, and their windows look for heavy keys in a sample.  Plans are shaped for large inputs: aggregate before
joining wherever the key allows it, leave broadcasts to known sizes, and never
run a window over a whole customer or category in one task (``windows.py``).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import (
    DEFAULT_SEGMENT_THRESHOLDS,
    customer_segment,
    flag,
    lifecycle_stage,
    reliability_score,
    retention_window,
)
from ..functions.numeric import exact_sample_stddev, round_to, safe_divide
from ..functions.temporal import elapsed_days, gap_days_2dp, micros_between, month_start
from .aggregates import (
    SUM_MONEY,
    customer_stats,
    first_per_key,
    max_value,
    money_sum,
    monthly_totals,
    order_totals,
    product_moments,
    with_month_parts,
)
from .filters import exclude_status, positive_amount
from .joins import attach_order_totals, join_small, with_global
from .shared import written_once
from .windows import ordered_sequence, running_total

UNKNOWN_CATEGORY = "Unknown"
EXCLUDED_STATUSES = ("canceled", "unavailable")


# ---------------------------------------------------------------- order fact
def fct_orders(stg_order: DataFrame, stg_items: DataFrame) -> DataFrame:
    """One row per order with zero-filled totals.  Items are aggregated first (no fan-out);
    the aggregate is already hashed by order_id, so the join shuffles the orders side only."""
    totals = order_totals(stg_items)
    j = attach_order_totals(stg_order.select("order_id", "customer_id", "order_status", "purchase_at"), totals)
    zero = F.lit(0).cast(SUM_MONEY)
    return j.select(
        "order_id",
        "customer_id",
        "order_status",
        "purchase_at",
        F.coalesce("total_price", zero).alias("total_price"),
        F.coalesce("total_freight", zero).alias("total_freight"),
        F.coalesce("total_order_amount", zero).alias("total_order_amount"),
        F.coalesce("total_items", F.lit(0).cast("bigint")).alias("total_items"),
    )


# ---------------------------------------------------------------- dimensions
def dim_products(stg_products: DataFrame, stg_translate: DataFrame) -> DataFrame:
    """Products with the translated category name (else the original) and volume."""
    t = stg_translate.select(
        F.col("category_name_pt").alias("product_category_name"), "category_name_en"
    )
    j = join_small(stg_products, t, "product_category_name", "left")
    return j.select(
        "product_id",
        F.coalesce("category_name_en", "product_category_name").alias("category_name"),
        "weight_g",
        "length_cm",
        "height_cm",
        "width_cm",
        (F.col("length_cm") * F.col("height_cm") * F.col("width_cm")).alias("volume_cm3"),
    )


def customers_unique(stg_customer: DataFrame) -> DataFrame:
    """One city/state per person; the row with the lowest customer_id wins."""
    return first_per_key(stg_customer, "customer_unique_id", ["customer_city", "customer_state"], "customer_id")


def dim_customer(
    fct: DataFrame, stg_customer: DataFrame, thresholds=DEFAULT_SEGMENT_THRESHOLDS
) -> DataFrame:
    """Person dimension: location, first/last order, counts, lifetime value, AOV, segment.

    Persons without orders are kept (left join) and land in the lead segment.
    Both join sides come out of aggregates keyed by person, so the join adds
    no exchange.
    """
    persons = customers_unique(stg_customer)
    stats = customer_stats(fct, stg_customer)
    j = persons.join(stats, "customer_unique_id", "left")
    return j.select(
        "customer_unique_id",
        "customer_city",
        "customer_state",
        "first_order_date",
        "last_order_date",
        F.coalesce("total_orders", F.lit(0).cast("bigint")).alias("total_orders"),
        F.coalesce("lifetime_value", F.lit(0).cast(SUM_MONEY)).alias("lifetime_value"),
        F.coalesce("average_order_value", F.lit(0).cast("decimal(18,2)")).alias("average_order_value"),
        customer_segment(F.col("lifetime_value"), thresholds).alias("customer_segment"),
    )


# ---------------------------------------------------------------- revenue
def monthly_revenue(fct: DataFrame) -> DataFrame:
    """Monthly orders, revenue and items of revenue-bearing orders."""
    return monthly_totals(positive_amount(exclude_status(fct, EXCLUDED_STATUSES), "total_order_amount"))


def month_product_totals(stg_order: DataFrame, stg_items: DataFrame) -> DataFrame:
    """Items joined to their order's month, pre-aggregated per (month, product).

    The order join is the one large shuffle; summing per product before the
    product lookup shrinks what the lookup and the category grouping move.
    """
    o = stg_order.select("order_id", month_start("purchase_at").alias("revenue_month"))
    li = stg_items.select("order_id", "product_id", "total_item_cost")
    return (
        o.join(li, "order_id", "inner")
        .groupBy("revenue_month", "product_id")
        .agg(F.sum("total_item_cost").alias("__cost"), F.count("product_id").alias("__n"))
    )


def monthly_revenue_by_cat(
    stg_order: DataFrame, stg_items: DataFrame, stg_products: DataFrame, stg_translate: DataFrame
) -> DataFrame:
    """Monthly revenue and units per English category; unmapped categories are 'Unknown'."""
    mp = month_product_totals(stg_order, stg_items)
    prods = stg_products.select("product_id", "product_category_name")
    lines = mp.join(prods, "product_id", "inner")
    t = stg_translate.select(F.col("category_name_pt").alias("product_category_name"), "category_name_en")
    lines = join_small(lines, t, "product_category_name", "left")
    agg = lines.groupBy(
        "revenue_month",
        F.coalesce("category_name_en", F.lit(UNKNOWN_CATEGORY)).alias("product_category"),
    ).agg(
        money_sum("__cost").alias("monthly_revenue"),
        F.sum("__n").cast("bigint").alias("product_sold"),
    )
    return with_month_parts(agg, "revenue_month").select(
        "revenue_month",
        "revenue_year",
        "revenue_month_num",
        "revenue_year_month",
        "product_category",
        "monthly_revenue",
        "product_sold",
    )


# ---------------------------------------------------------------- product cost decomposition
def product_base_stats(stg_items: DataFrame, dim: DataFrame) -> DataFrame:
    """Per product: counts, rounded means, volatilities and reliability.

    Items are aggregated per product before the dimension join; equivalent to
    join-then-group because the dimension key is unique.
    """
    m = product_moments(stg_items)
    d = dim.select("product_id", F.coalesce("category_name", F.lit(UNKNOWN_CATEGORY)).alias("category"))
    j = m.join(d, "product_id", "inner")
    return j.select(
        "product_id",
        "category",
        "sales_count",
        "avg_price",
        "avg_freight",
        "avg_total_cost",
        reliability_score(F.col("sales_count")).alias("reliability_score"),
        "price_volatility",
        "freight_volatility",
        "total_cost_volatility",
    )


def category_benchmarks(base: DataFrame) -> DataFrame:
    """Per category: mean and sample stddev of product mean cost, mean product freight."""
    return base.groupBy("category").agg(
        (F.sum("avg_total_cost").cast("double") / F.count("avg_total_cost").cast("double")).alias(
            "cat_avg_total_cost"
        ),
        exact_sample_stddev("avg_total_cost").alias("cat_stddev_total_cost"),
        (F.sum("avg_freight").cast("double") / F.count("avg_freight").cast("double")).alias("cat_avg_freight_share"),
    )


def is_price_rebalanced(ratio: Decimal = Decimal("0.3")):
    """Flag: total-cost volatility below ``ratio`` of price+freight volatility, more than one
    sale, and some volatility; NULL comparisons count as false."""
    pv, fv, tv = F.col("price_volatility"), F.col("freight_volatility"), F.col("total_cost_volatility")
    pred = (tv < (pv + fv) * F.lit(ratio)) & (F.col("sales_count") > 1) & ((pv > 0) | (fv > 0))
    return flag(pred)


def cost_features(base: DataFrame, corrected: bool = False) -> DataFrame:
    """Freight share, category benchmarks (group aggregate joined back), z-score, CV, revenue.

    ``base`` is written once: the benchmarks, the join and the search for heavy categories read it.
    """
    base = written_once(base, "product-base")
    bench = category_benchmarks(base)
    j = join_small(base, bench, "category", "left")
    freight_share = safe_divide(F.col("avg_freight"), F.col("avg_total_cost")) * 100.0
    out = j.select(
        *base.columns,
        freight_share.alias("freight_share_pct"),
        "cat_avg_total_cost",
        "cat_stddev_total_cost",
        "cat_avg_freight_share",
        is_price_rebalanced().alias("is_price_rebalanced"),
    ).select(
        "*",
        safe_divide(
            F.col("avg_total_cost").cast("double") - F.col("cat_avg_total_cost"), F.col("cat_stddev_total_cost")
        ).alias("total_cost_z_score"),
        (F.col("freight_share_pct") - F.col("cat_avg_freight_share")).alias("freight_pct_diff_from_avg"),
        safe_divide(F.col("total_cost_volatility"), F.col("avg_total_cost")).alias("total_cost_cv"),
        (F.col("avg_price") * F.col("sales_count")).cast(SUM_MONEY).alias("product_revenue"),
    )
    if corrected:
        out = freight_share_corrected(out)
    return out


def freight_share_corrected(df: DataFrame) -> DataFrame:
    """The like-for-like variant: category mean of freight *share* and the difference to it."""
    from .windows import with_group_stats

    j = with_group_stats(df, "category", [F.avg("freight_share_pct").alias("__cat_fsp")])
    # a mean of doubles depends on summation order in its last bits: publish 9 places
    return j.withColumn("freight_share_pct_diff", round_to(F.col("freight_share_pct") - F.col("__cat_fsp"), 9)).withColumn(
        "cat_avg_freight_share_pct", round_to(F.col("__cat_fsp"), 9)
    ).drop("__cat_fsp")


def pareto(df: DataFrame, value: str = "product_revenue", by: str = "category", cutoff: Decimal = Decimal("0.8")) -> DataFrame:
    """Pareto columns within ``by``: running value (desc, ties share), group total, share %,
    running %, workhorse flag (running share ≤ cutoff, compared exactly)."""
    r = running_total(df, by, value, "cumulative_category_revenue", "total_category_revenue")
    cum, tot, v = F.col("cumulative_category_revenue"), F.col("total_category_revenue"), F.col(value)
    num, den = cutoff.as_integer_ratio()
    return r.select(
        "*",
        round_to(safe_divide(v, tot) * 100.0, 4).alias("product_revenue_share_pct"),
        round_to(safe_divide(cum, tot) * 100.0, 4).alias("pareto_revenue_pct"),
        flag(F.when(tot != 0, cum * den <= tot * num)).alias("is_revenue_workhorse"),
    )


def product_cost_decomposition(stg_items: DataFrame, dim: DataFrame, corrected: bool = False) -> DataFrame:
    """The 24-column product cost mart."""
    base = product_base_stats(stg_items, dim)
    feats = cost_features(base, corrected)
    return pareto(feats)


# ---------------------------------------------------------------- retention
def order_mapping(fct: DataFrame, stg_customer: DataFrame) -> DataFrame:
    """order → person (inner join on the order-level customer id)."""
    return fct.select("order_id", "customer_id", "purchase_at").join(
        stg_customer.select("customer_id", "customer_unique_id"), "customer_id", "inner"
    ).select("order_id", "purchase_at", "customer_unique_id")


def retention_facts(mapping: DataFrame) -> DataFrame:
    """Per order: previous order time, sequence, person order count, gap days, recency days.

    Ordering is (purchase_at ASC NULLS LAST, order_id): ties are broken by
    order id so results are deterministic.  The dataset max is a one-row
    aggregate joined by broadcast.  ``mapping`` is written once: the search for
    heavy persons, the dataset max and the windows read it.
    """
    mapping = written_once(mapping, "order-mapping")
    seq = ordered_sequence(
        mapping,
        "customer_unique_id",
        "purchase_at",
        "order_id",
        seq="order_sequence",
        prev="previous_order_at",
        group_rows="total_customer_orders",
    )
    maxd = max_value(mapping, "purchase_at", "max_data_date")
    j = with_global(seq, maxd)
    gap = micros_between(F.col("purchase_at"), F.col("previous_order_at"))
    return j.select(
        "customer_unique_id",
        "order_id",
        "purchase_at",
        "previous_order_at",
        "order_sequence",
        "total_customer_orders",
        gap.alias("gap_micros"),
        gap_days_2dp(gap).alias("days_between_orders"),
        elapsed_days(F.col("max_data_date"), F.col("purchase_at")).alias("recency_days"),
    )


def with_retention_labels(facts: DataFrame, lapsed_days: int = 365, quick: int = 30, standard: int = 90) -> DataFrame:
    """The published retention columns with lifecycle stage and return window."""
    seq, tot = F.col("order_sequence"), F.col("total_customer_orders")
    return facts.select(
        "customer_unique_id",
        "order_id",
        F.col("purchase_at").alias("most_recent_purchase_at"),
        "previous_order_at",
        F.coalesce(seq.cast("bigint"), F.lit(0).cast("bigint")).alias("order_sequence"),
        F.coalesce(tot, F.lit(0).cast("bigint")).alias("total_customer_orders"),
        "days_between_orders",
        "recency_days",
        lifecycle_stage(seq, tot, F.col("recency_days"), lapsed_days).alias("lifecycle_stage"),
        retention_window(seq, F.col("gap_micros"), quick, standard).alias("retention_window"),
    )


def customer_retention(fct: DataFrame, stg_customer: DataFrame) -> DataFrame:
    """The 10-column retention mart, one row per order of a known person."""
    return with_retention_labels(retention_facts(order_mapping(fct, stg_customer)))
