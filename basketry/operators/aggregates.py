"""Grouped aggregates.  All are ``groupBy().agg()`` with decomposable functions,
so Spark runs a map-side partial aggregate before the shuffle and a hot key
never gathers its raw rows in one task.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import cents, exact_rounded_mean, exact_sample_stddev, round_to, rounded_mean_from_parts
from ..functions.temporal import month_of, month_start, year_month_label, year_of

SUM_MONEY = "decimal(38,2)"


def money_sum(c: Column | str) -> Column:
    """Exact sum of a money column as DECIMAL(38,2)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c).cast(SUM_MONEY)


def order_totals(items: DataFrame) -> DataFrame:
    """Per order: summed price, freight and total (exact decimals), and non-null product count."""
    return items.groupBy("order_id").agg(
        money_sum("price").alias("total_price"),
        money_sum("freight_value").alias("total_freight"),
        money_sum("total_item_cost").alias("total_order_amount"),
        F.count("product_id").alias("total_items"),
    )


def customer_order_partials(fct: DataFrame) -> DataFrame:
    """Per order-level customer id: min/max time, order count, amount sum and cents sum.

    Aggregating by ``customer_id`` before the join to persons shrinks the fact
    to one row per customer id; every part combines again by person.
    """
    return fct.groupBy("customer_id").agg(
        F.min("purchase_at").alias("first_order_date"),
        F.max("purchase_at").alias("last_order_date"),
        F.count("order_id").alias("total_orders"),
        F.sum("total_order_amount").alias("lifetime_value"),
        F.sum(cents("total_order_amount")).alias("__amount_cents"),
        F.count("total_order_amount").alias("__amount_n"),
    )


def customer_stats(fct: DataFrame, customers: DataFrame) -> DataFrame:
    """Per person: first/last order time, order count, lifetime value, rounded mean order value."""
    parts = customer_order_partials(fct)
    bridged = parts.join(customers.select("customer_id", "customer_unique_id"), "customer_id", "inner")
    s = bridged.groupBy("customer_unique_id").agg(
        F.min("first_order_date").alias("first_order_date"),
        F.max("last_order_date").alias("last_order_date"),
        F.sum("total_orders").cast("bigint").alias("total_orders"),
        F.sum("lifetime_value").cast(SUM_MONEY).alias("lifetime_value"),
        F.sum("__amount_cents").alias("__s"),
        F.sum("__amount_n").alias("__n"),
    )
    return s.select(
        "customer_unique_id",
        "first_order_date",
        "last_order_date",
        "total_orders",
        "lifetime_value",
        rounded_mean_from_parts(F.col("__s"), F.col("__n")).alias("average_order_value"),
    )


def max_value(df: DataFrame, col: str, alias: str) -> DataFrame:
    """Global max as a one-row frame (scalar subquery)."""
    return df.agg(F.max(col).alias(alias))


def first_per_key(df: DataFrame, key: str, cols: list[str], tie: str) -> DataFrame:
    """One row per ``key`` (``DISTINCT ON``): the row with the lowest ``tie`` value.

    ``min_by`` combines map-side (partial aggregate), so no whole group reaches
    one task; Spark runs it as a sort-based aggregate because its buffer holds
    a struct, with no window and no ordering of whole groups.
    """
    picked = df.groupBy(key).agg(F.min_by(F.struct(*cols), F.col(tie)).alias("__pick"))
    return picked.select(key, *[F.col(f"__pick.{c}").alias(c) for c in cols])


def monthly_totals(fct: DataFrame) -> DataFrame:
    """Per purchase month: order count, revenue, items."""
    return fct.groupBy(month_start("purchase_at").alias("order_month")).agg(
        F.count("order_id").alias("total_fullfilled_orders"),
        money_sum("total_order_amount").alias("revenue"),
        F.sum("total_items").cast("bigint").alias("items_sold"),
    )


def with_month_parts(df: DataFrame, month_col: str, prefix: str = "revenue") -> DataFrame:
    """Derive year, month number and 'YYYY-MM' from a month-start DATE (grouping on one key)."""
    m = F.col(month_col)
    return df.select(
        "*",
        year_of(m).alias(f"{prefix}_year"),
        month_of(m).alias(f"{prefix}_month_num"),
        year_month_label(m).alias(f"{prefix}_year_month"),
    )


def product_moments(items: DataFrame) -> DataFrame:
    """Per product: sale count, exact rounded means and sample standard deviations."""
    return items.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("sales_count"),
        exact_rounded_mean("price").alias("avg_price"),
        exact_rounded_mean("freight_value").alias("avg_freight"),
        exact_rounded_mean("total_item_cost").alias("avg_total_cost"),
        round_to(F.coalesce(exact_sample_stddev("price"), F.lit(0.0)), 4, "decimal(18,4)").alias("price_volatility"),
        round_to(F.coalesce(exact_sample_stddev("freight_value"), F.lit(0.0)), 4, "decimal(18,4)").alias(
            "freight_volatility"
        ),
        round_to(F.coalesce(exact_sample_stddev("total_item_cost"), F.lit(0.0)), 4, "decimal(18,4)").alias(
            "total_cost_volatility"
        ),
    )


def histogram(df: DataFrame, col: str, width: float, start: float = 0.0) -> DataFrame:
    """Fixed-width histogram: bin = floor((x - start) / width); NULL values are not counted."""
    x = F.col(col).cast("double")
    b = F.floor((x - F.lit(float(start))) / F.lit(float(width)))
    return (
        df.where(F.col(col).isNotNull())
        .groupBy(b.cast("bigint").alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(
            "bin",
            (F.col("bin") * F.lit(float(width)) + F.lit(float(start))).alias("bin_start"),
            (F.col("bin") * F.lit(float(width)) + F.lit(float(start)) + F.lit(float(width))).alias("bin_end"),
            "count",
        )
    )


def nice_width(df: DataFrame, col: str, most: int) -> Decimal:
    """The least width 1, 2 or 5 times a power of ten whose aligned bins cover ``col`` in at most ``most`` bins.

    One pass for the smallest and largest value; the search runs over those two
    numbers.  A column of one value, or without any, has width 1.
    """
    x = F.col(col).cast("decimal(38,9)")
    s = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    if s["lo"] is None or s["lo"] == s["hi"]:
        return Decimal(1)
    # a width of the span / most is too small by less than a factor of ten
    exponent = ((s["hi"] - s["lo"]) / most).adjusted()
    widths = (Decimal(step).scaleb(exponent + k) for k in range(3) for step in (1, 2, 5))
    return next(w for w in widths if s["hi"] // w - s["lo"] // w + _below(s["lo"], w) - _below(s["hi"], w) + 1 <= most)


def _below(x: Decimal, w: Decimal) -> int:
    """1 where Decimal's division (towards zero) lies above the floor."""
    return int(x < 0 and x % w != 0)


def nice_histogram(df: DataFrame, col: str, most: int) -> DataFrame:
    """(bin, bin_start, bin_end, count): aligned bins of a readable width, at most ``most``; NULL values are not counted.

    Bins are cut in exact decimals, so a value on a border is in the bin it starts.
    """
    width = F.lit(nice_width(df, col, most)).cast("decimal(20,9)")
    b = F.floor(F.col(col).cast("decimal(20,9)") / width).cast("bigint")
    counts = df.where(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    edge = lambda n: (n.cast("decimal(18,0)") * width).cast("decimal(28,9)")
    return counts.select("bin", edge(F.col("bin")).alias("bin_start"), edge(F.col("bin") + 1).alias("bin_end"), "count")


def distinct_sorted(df: DataFrame, col: str, cast: str | None = None) -> DataFrame:
    """Sorted distinct values of one column (a small result: the value domain)."""
    c = F.col(col).cast(cast).alias(col) if cast else F.col(col)
    return df.select(c).distinct().orderBy(F.asc_nulls_last(col))


def yearly_avg_revenue(rev: DataFrame, half_even: bool = False) -> DataFrame:
    """Mean monthly revenue per (category, year), rounded to 2 places: half away from zero
    (exact, from cents), or ties to even with ``half_even=True``."""
    if half_even:
        mean = F.sum("monthly_revenue").cast("decimal(38,6)") / F.count("monthly_revenue")
        avg = round_to(mean, 2, "decimal(18,2)", half_even=True)
    else:
        avg = exact_rounded_mean("monthly_revenue")
    return rev.groupBy("product_category", "revenue_year").agg(avg.alias("avg_monthly_revenue"))
