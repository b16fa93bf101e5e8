"""Row filters.  Plain ``where`` predicates that Catalyst pushes toward the scan;
SQL three-valued logic throughout (a NULL predicate drops the row).
"""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import RELIABILITY_SINGLE, RESULT_ANOMALY


def exclude_status(df: DataFrame, statuses: Iterable[str], col: str = "order_status") -> DataFrame:
    """``status NOT IN (...)``; a NULL status is dropped, as in SQL."""
    return df.where(~F.col(col).isin(list(statuses)))


def positive_amount(df: DataFrame, col: str) -> DataFrame:
    """Rows whose amount is above zero (NULL dropped)."""
    return df.where(F.col(col) > 0)


#: Selections up to this many values are pushed to the scan as a predicate; longer ones are joined.
PREDICATE_VALUES = 500


def in_values(df: DataFrame, col: str, values: Iterable) -> DataFrame:
    """Membership filter; an empty selection gives an empty frame, NULL is in none.

    A short selection is a predicate that reaches the scan.  A long one becomes
    a left semi join with the distinct values: the plan holds one relation
    instead of a literal per value, its size in bytes decides between a broadcast
    and a shuffle, and its values still prune partition folders at run time.
    """
    values = [v for v in dict.fromkeys(values) if v is not None]
    if len(values) <= PREDICATE_VALUES:
        return df.where(F.col(col).isin(values))
    wanted = pa.table({"__wanted": pa.array(values)})
    side = df.sparkSession.createDataFrame(wanted).select(F.col("__wanted").cast(df.schema[col].dataType))
    return df.join(side, F.col(col) == F.col("__wanted"), "left_semi")


def in_categories(df: DataFrame, categories: Iterable[str], col: str = "category") -> DataFrame:
    """Rows of the selected categories; an empty selection gives an empty frame."""
    return in_values(df, col, categories)


def in_category_year(
    df: DataFrame,
    categories: Iterable[str],
    years: Iterable[int],
    cat_col: str = "product_category",
    year_col: str = "revenue_year",
) -> DataFrame:
    """Rows of the selected categories and years."""
    return in_values(in_values(df, cat_col, categories), year_col, years)


def reliable_only(df: DataFrame, col: str = "reliability_score") -> DataFrame:
    """Drop single-sale products before model training."""
    return df.where(F.col(col) != RELIABILITY_SINGLE)


def workhorses(df: DataFrame, col: str = "is_revenue_workhorse") -> DataFrame:
    """Products inside their category's top revenue share."""
    return df.where(F.col(col))


def anomalies_only(df: DataFrame, col: str = "Result") -> DataFrame:
    """Rows labelled as anomalies."""
    return df.where(F.col(col) == RESULT_ANOMALY)


def repeat_orders(df: DataFrame, col: str = "order_sequence") -> DataFrame:
    """Orders after a person's first one."""
    return df.where(F.col(col) > 1)


def true_repeats(df: DataFrame, threshold_days: float = 0.05, gap_col: str = "days_between_orders") -> DataFrame:
    """Repeat orders whose (rounded) gap is above the technical-split threshold; NULL gap dropped."""
    thr = F.lit(Decimal(str(threshold_days)))
    return df.where((F.col("order_sequence") > 1) & (F.col(gap_col) > thr))


drop_technical_splits = true_repeats
