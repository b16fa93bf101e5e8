"""Dashboard metrics over the marts: one-row KPI frames and small distributions.

Every metric is a single aggregate over the distributed mart; only the
result row(s) — never the mart — would reach the driver.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import RESULT_ANOMALY
from ..functions.numeric import percent, round_to, safe_divide


def unique_customers(ret: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct persons (exact; ``approx=True`` uses a HyperLogLog++ sketch)."""
    c = F.approx_count_distinct("customer_unique_id") if approx else F.count_distinct("customer_unique_id")
    return ret.agg(c.cast("bigint").alias("total_customers"))


#: Buckets of a sketch of distinct persons (a power of two), and what an estimate may be off by: four standard errors.
SKETCH_BITS = 14
SKETCH_ERROR = 4 * 1.04 / 2 ** (SKETCH_BITS / 2)


def person_sketches(ret: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """(order_month, orders, persons binary): a HyperLogLog sketch of each month's distinct persons.

    Sketches merge: distinct persons of any months come from their union, so a
    selection of months is answered from a few kilobytes a month, and a new
    month adds a row without a scan of the older ones.  Null persons are not counted.
    """
    month = F.date_trunc("month", F.col("most_recent_purchase_at")).cast("date").alias("order_month")
    sketch = F.hll_sketch_agg(F.col("customer_unique_id").cast("string"), bits)
    return ret.groupBy(month).agg(F.count(F.lit(1)).alias("orders"), sketch.alias("persons"))


def persons_of(sketches: DataFrame, by: list | None = None) -> DataFrame:
    """Estimated distinct persons of all rows of ``person_sketches``, or of each group of them."""
    united = sketches.groupBy(*(by or [])).agg(F.hll_union_agg("persons").alias("persons"), F.sum("orders").alias("orders"))
    return united.select(*[c for c in united.columns if c not in ("persons", "orders")], "orders", F.hll_sketch_estimate("persons").alias("persons"))


def repeat_rate(ret: DataFrame) -> DataFrame:
    """Share of *orders* that are repeats, in percent (NULL on an empty mart)."""
    return ret.agg(
        F.count(F.lit(1)).alias("orders"),
        F.count_if(F.col("order_sequence") > 1).alias("repeat_orders"),
    ).select(
        "orders",
        "repeat_orders",
        round_to(safe_divide(F.col("repeat_orders"), F.col("orders")) * 100.0, 2).alias("repeat_rate_pct"),
    )


def customer_repeat_rate(ret: DataFrame) -> DataFrame:
    """Share of *persons* with more than one order, in percent."""
    per = ret.groupBy("customer_unique_id").agg(F.max("total_customer_orders").alias("n"))
    return per.agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(F.col("n") > 1).alias("repeat_customers"),
    ).select(
        "customers",
        "repeat_customers",
        round_to(safe_divide(F.col("repeat_customers"), F.col("customers")) * 100.0, 2).alias(
            "customer_repeat_rate_pct"
        ),
    )


def lifecycle_distribution(ret: DataFrame, col: str = "lifecycle_stage") -> DataFrame:
    """Count per label and its share of all rows (percent, 2 places)."""
    counts = ret.groupBy(col).agg(F.count(F.lit(1)).alias("orders"))
    total = ret.agg(F.count(F.lit(1)).alias("__total"))
    return counts.crossJoin(F.broadcast(total)).select(
        col, "orders", round_to(safe_divide(F.col("orders"), F.col("__total")) * 100.0, 2).alias("share_pct")
    )


def same_day_kpis(ret: DataFrame, threshold_days: float = 0.05) -> DataFrame:
    """Repeat orders less than a day after the previous one (NULL gap counted as 0), the credible
    ones among them (gap above the threshold), and the difference (technical splits)."""
    rep = F.col("order_sequence") > 1
    gap = F.col("days_between_orders")
    thr = F.lit(Decimal(str(threshold_days)))
    return ret.agg(
        F.count_if(rep & (F.coalesce(gap, F.lit(0)) < 1)).alias("same_day_orders"),
        F.count_if(rep & (gap > thr) & (gap < 1)).alias("credible_same_day_orders"),
    ).select(
        "same_day_orders",
        "credible_same_day_orders",
        (F.col("same_day_orders") - F.col("credible_same_day_orders")).alias("technical_splits"),
    )


def max_gap(ret: DataFrame, threshold_days: float = 0.05) -> DataFrame:
    """Largest gap among true repeats and the chart bound (×1.05)."""
    thr = F.lit(Decimal(str(threshold_days)))
    m = ret.where((F.col("order_sequence") > 1) & (F.col("days_between_orders") > thr)).agg(
        F.max("days_between_orders").alias("max_gap_days")
    )
    return m.select("max_gap_days", (F.col("max_gap_days") * F.lit(Decimal("1.05"))).cast("decimal(20,4)").alias("axis_max"))


def anomaly_kpis(labelled: DataFrame, result_col: str = "Result") -> DataFrame:
    """Analysed products, anomalies, anomaly percent (1 place)."""
    return labelled.agg(
        F.count(F.lit(1)).alias("items_analyzed"),
        F.count_if(F.col(result_col) == RESULT_ANOMALY).alias("anomalies"),
    ).select("items_analyzed", "anomalies", percent(F.col("anomalies"), F.col("items_analyzed"), 1).alias("anomaly_pct"))


def pareto_kpis(prod: DataFrame) -> DataFrame:
    """Workhorse products and their percent of all listed products (single sales included)."""
    return prod.agg(
        F.count(F.lit(1)).alias("total_products"),
        F.count_if(F.col("is_revenue_workhorse")).alias("workhorse_products"),
    ).select(
        "total_products",
        "workhorse_products",
        percent(F.col("workhorse_products"), F.col("total_products"), 1).alias("inventory_pct"),
    )
