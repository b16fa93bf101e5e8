"""Exact quantiles of a distributed column, at any size the same way.

The value at a rank is found by histograms: each pass counts the rows of a
fixed number of equal bins over the range still in question, and goes on
with the bin that holds the rank, over the smallest and largest value in it.
Only bin counts reach the driver, and no task buffers the column.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 4096


def value_at_rank(df: DataFrame, col: str, rank: int, lo: float, hi: float) -> tuple[float, int]:
    """(value, rows at or below it) of the ``rank``-th smallest (from 0) non-null value in [lo, hi]."""
    below = 0
    x = F.col(col)
    while lo < hi:
        width = (hi - lo) / BINS
        # a range of neighbouring doubles may have no smaller step
        bin_ = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(BINS - 1)) if width > 0 else F.when(x <= lo, 0).otherwise(1)
        rows = df.where((x >= F.lit(lo)) & (x <= F.lit(hi))).groupBy(bin_.alias("b"))
        for r in sorted(rows.agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect(), key=lambda r: r["b"]):
            if rank < below + r["n"]:
                if (r["lo"], r["hi"]) == (lo, hi):  # rounding keeps unequal neighbours in one bin
                    n = df.where(x == F.lit(lo)).count()
                    return (lo, below + n) if rank < below + n else (hi, below + r["n"])
                lo, hi, count = r["lo"], r["hi"], r["n"]
                break
            below += r["n"]
        if lo == hi:
            return lo, below + count
    return lo, df.where(x == F.lit(lo)).count()


def exact_quantile(df: DataFrame, col: str, q: float) -> float | None:
    """The ``q`` quantile of the non-null values, linearly interpolated; None without any.

    ``col`` is read several times: give a written or checkpointed frame.
    """
    x = F.col(col).cast("double")
    df = df.select(x.alias("x")).where("x is not null")
    s = df.agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if not s["n"]:
        return None
    at = q * (s["n"] - 1)
    rank = min(int(math.floor(at)), s["n"] - 1)
    value, upto = value_at_rank(df, "x", rank, s["lo"], s["hi"])
    part = at - rank
    if part == 0 or rank + 1 < upto or rank + 1 >= s["n"]:
        return float(value)
    above = df.where(F.col("x") > F.lit(value)).agg(F.min("x")).first()[0]
    return float(value + (above - value) * part)
