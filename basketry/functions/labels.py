"""Label columns (searched CASE chains).  Branch order matters: first match wins.

Thresholds are parameters; the label texts are fixed values that downstream
checks and dashboards match on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label texts as the marts publish them.
SEGMENT_VIP = "VIP"
SEGMENT_HIGH = "High Value"
SEGMENT_MEDIUM = "Medium Value"
SEGMENT_LOW = "Low Value"
SEGMENT_LEAD = "Lead / No Purchase"

RELIABILITY_SINGLE = "Single Sale"
RELIABILITY_LOW = "Low Confidence"
RELIABILITY_HIGH = "High Confidence"

STAGE_REPEAT = "Repeat Transaction"
STAGE_LOYALIST = "Initial Purchase (Loyalist)"
STAGE_LAPSED = "Lapsed (One-Time)"
STAGE_NEW = "New (Potential Repeat)"
STAGE_NONE = "No Order"

WINDOW_FIRST = "First Order"
WINDOW_QUICK = "Quick Return (<30d)"
WINDOW_STANDARD = "Standard (30-90d)"
WINDOW_DELAYED = "Delayed (>90d)"

RESULT_NORMAL = "Normal"
RESULT_ANOMALY = "Anomaly"
RESULT_UNSCORED = "Single sale - No Analysis"

DEFAULT_SEGMENT_THRESHOLDS = (3000, 1000, 200)


def customer_segment(ltv: Column, thresholds=DEFAULT_SEGMENT_THRESHOLDS) -> Column:
    """VIP / High / Medium at the three thresholds (inclusive), Low if > 0, else Lead."""
    vip, high, medium = thresholds
    return (
        F.when(ltv >= vip, SEGMENT_VIP)
        .when(ltv >= high, SEGMENT_HIGH)
        .when(ltv >= medium, SEGMENT_MEDIUM)
        .when(ltv > 0, SEGMENT_LOW)
        .otherwise(SEGMENT_LEAD)
    )


def reliability_score(sales_count: Column, high: int = 4) -> Column:
    """1 sale -> Single Sale, fewer than ``high`` -> Low Confidence, else High Confidence."""
    return (
        F.when(sales_count == 1, RELIABILITY_SINGLE)
        .when(sales_count < high, RELIABILITY_LOW)
        .otherwise(RELIABILITY_HIGH)
    )


def lifecycle_stage(seq: Column, total: Column, recency_days: Column, lapsed_days: int = 365) -> Column:
    """Repeat / Loyalist first order / Lapsed or New one-timer / No Order (NULL recency)."""
    return (
        F.when(seq > 1, STAGE_REPEAT)
        .when((seq == 1) & (total > 1), STAGE_LOYALIST)
        .when((total == 1) & (recency_days > lapsed_days), STAGE_LAPSED)
        .when((total == 1) & (recency_days <= lapsed_days), STAGE_NEW)
        .otherwise(STAGE_NONE)
    )


def retention_window(seq: Column, gap_micros: Column, quick: int = 30, standard: int = 90) -> Column:
    """First order / quick (≤ quick days) / standard (≤ standard days) / delayed.

    Compared on the exact, unrounded gap (microseconds); a NULL gap on a
    non-first order falls through to 'Delayed', as a SQL CASE does.
    """
    day = 86_400_000_000
    return (
        F.when(seq == 1, WINDOW_FIRST)
        .when(gap_micros <= quick * day, WINDOW_QUICK)
        .when(gap_micros <= standard * day, WINDOW_STANDARD)
        .otherwise(WINDOW_DELAYED)
    )


def flag(pred: Column) -> Column:
    """CASE WHEN pred THEN true ELSE false: NULL becomes false."""
    return F.coalesce(pred, F.lit(False))


def value_map(c: Column, mapping: dict) -> Column:
    """The mapped value; NULL for a value that the mapping lacks."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.create_map(*pairs)[c]
