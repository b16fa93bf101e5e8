from __future__ import annotations

import datetime as dt
from decimal import Decimal
from decimal import Decimal as D

from pyspark.sql import functions as F

from basketry.functions import labels as L
from basketry.functions.numeric import exact_rounded_mean, exact_sample_stddev, percent, round_to, safe_divide
from basketry.functions.temporal import (
    days_between,
    elapsed_days,
    gap_days_2dp,
    micros_between,
    month_start,
    year_month_label,
)


def test_exact_mean_rounds_half_away_from_zero(spark):
    df = spark.createDataFrame(
        [("a", Decimal("0.01")), ("a", Decimal("0.02")), ("b", Decimal("1.00")), ("b", Decimal("1.01")),
         ("c", Decimal("-0.01")), ("c", Decimal("-0.02")), ("d", None)],
        "k string, x decimal(18,2)",
    )
    got = dict(df.groupBy("k").agg(exact_rounded_mean("x").alias("m")).collect())
    # 0.015 -> 0.02, 1.005 -> 1.01, -0.015 -> -0.02, all-NULL -> NULL
    assert got == {"a": Decimal("0.02"), "b": Decimal("1.01"), "c": Decimal("-0.02"), "d": None}


def test_exact_stddev_matches_sample_formula(spark):
    vals = [Decimal("10.00"), Decimal("12.50"), Decimal("9.99"), Decimal("100.01")]
    df = spark.createDataFrame([("a", v) for v in vals] + [("one", Decimal("5.00"))], "k string, x decimal(18,2)")
    got = dict(df.groupBy("k").agg(exact_sample_stddev("x").alias("s")).collect())
    import statistics

    assert abs(got["a"] - statistics.stdev([float(v) for v in vals])) < 1e-9
    assert got["one"] is None


def test_round_to_and_safe_divide(spark):
    df = spark.createDataFrame([(1.23455, 2.0, 0.0)], "a double, b double, z double")
    r = df.select(
        round_to(F.col("a"), 4).alias("r4"),
        safe_divide(F.col("a"), F.col("z")).alias("div0"),
        safe_divide(F.col("b"), F.lit(4.0)).alias("half"),
        percent(F.lit(1), F.lit(3), 1).alias("p"),
    ).first()
    assert r.r4 == Decimal("1.2346") or r.r4 == Decimal("1.2345")  # binary repr of 1.23455 decides
    assert r.div0 is None and r.half == 0.5 and r.p == Decimal("33.3")


def test_gap_days_and_elapsed_days(spark):
    t0 = dt.datetime(2020, 1, 1, 23, 0, 0)
    rows = [
        (t0, t0 + dt.timedelta(hours=2)),  # 0.0833 days; one calendar boundary but 0 elapsed days
        (t0, t0 + dt.timedelta(days=0.05)),
        (t0, t0 + dt.timedelta(days=0.055)),  # rounds half up to 0.06
        (t0, t0 + dt.timedelta(days=61, hours=-1)),  # 60 elapsed days, 61 calendar days
        (t0, None),
    ]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    out = df.select(
        gap_days_2dp(micros_between("b", "a")).alias("g"),
        elapsed_days("b", "a").alias("e"),
        F.datediff(F.col("b"), F.col("a")).alias("cal"),
        days_between("b", "a").alias("d"),
    ).collect()
    assert [r.g for r in out] == [Decimal("0.08"), Decimal("0.05"), Decimal("0.06"), Decimal("60.96"), None]
    assert [r.e for r in out] == [0, 0, 0, 60, None]
    assert out[3].cal == 61  # calendar-day count differs from elapsed days
    assert abs(out[0].d - 2 / 24) < 1e-12


def test_month_functions(spark):
    df = spark.createDataFrame([(dt.datetime(2017, 3, 31, 23, 59, 59),)], "t timestamp_ntz")
    r = df.select(month_start("t").alias("m"), year_month_label("t").alias("l")).first()
    assert r.m == dt.date(2017, 3, 1) and r.l == "2017-03"


def test_label_branches(spark):
    df = spark.createDataFrame(
        [(Decimal(v),) for v in ["3000", "2999.99", "1000", "200", "199.99", "0.01", "0"]] + [(None,)],
        "ltv decimal(18,2)",
    )
    got = [r[0] for r in df.select(L.customer_segment(F.col("ltv"))).collect()]
    assert got == ["VIP", "High Value", "High Value", "Medium Value", "Low Value", "Low Value",
                   "Lead / No Purchase", "Lead / No Purchase"]
    s = spark.createDataFrame([(1,), (2,), (3,), (4,)], "n int")
    assert [r[0] for r in s.select(L.reliability_score(F.col("n"))).collect()] == [
        "Single Sale", "Low Confidence", "Low Confidence", "High Confidence"]
    lc = spark.createDataFrame(
        [(2, 3, 5), (1, 2, 5), (1, 1, 366), (1, 1, 365), (1, 1, None)], "seq int, tot int, rec int"
    )
    assert [r[0] for r in lc.select(L.lifecycle_stage(F.col("seq"), F.col("tot"), F.col("rec"))).collect()] == [
        "Repeat Transaction", "Initial Purchase (Loyalist)", "Lapsed (One-Time)", "New (Potential Repeat)", "No Order"]
    day = 86_400_000_000
    rw = spark.createDataFrame(
        [(1, None), (2, 30 * day), (2, 30 * day + 1), (2, 90 * day), (2, 90 * day + 1), (2, None)],
        "seq int, g bigint",
    )
    assert [r[0] for r in rw.select(L.retention_window(F.col("seq"), F.col("g"))).collect()] == [
        "First Order", "Quick Return (<30d)", "Standard (30-90d)", "Standard (30-90d)", "Delayed (>90d)",
        "Delayed (>90d)"]


def test_exact_mean_and_stddev_property(spark):
    """Random money lists: mean equals Decimal half-up rounding of the true mean; stddev equals
    the sample formula."""
    import statistics
    from decimal import ROUND_HALF_UP

    from hypothesis import given, settings
    from hypothesis import strategies as st

    money = st.integers(min_value=-10_000_000, max_value=10_000_000).map(lambda c: D(c) / 100)

    @settings(max_examples=15, deadline=None)
    @given(st.lists(st.lists(money, min_size=1, max_size=12), min_size=1, max_size=6))
    def check(groups):
        rows = [(g, v) for g, vals in enumerate(groups) for v in vals]
        df = spark.createDataFrame(rows, "g int, x decimal(18,2)")
        got = {r.g: (r.m, r.s) for r in df.groupBy("g").agg(
            exact_rounded_mean("x").alias("m"), exact_sample_stddev("x").alias("s")).collect()}
        for g, vals in enumerate(groups):
            exact = sum(vals) / len(vals)
            want = exact.quantize(D("0.01"), rounding=ROUND_HALF_UP)
            assert got[g][0] == want
            if len(vals) > 1:
                assert abs(got[g][1] - statistics.stdev([float(v) for v in vals])) <= 1e-9 * max(1.0, got[g][1])
            else:
                assert got[g][1] is None

    check()


def test_half_even_option(spark):
    from basketry.operators.aggregates import yearly_avg_revenue

    rev = spark.createDataFrame(
        [("a", 2020, D("0.01")), ("a", 2020, D("0.02")), ("b", 2020, D("0.01")), ("b", 2020, D("0.04"))],
        "product_category string, revenue_year bigint, monthly_revenue decimal(38,2)",
    )
    up = dict((r.product_category, r.avg_monthly_revenue) for r in yearly_avg_revenue(rev).collect())
    even = dict((r.product_category, r.avg_monthly_revenue) for r in yearly_avg_revenue(rev, half_even=True).collect())
    assert up == {"a": D("0.02"), "b": D("0.03")}  # 0.015 -> 0.02, 0.025 -> 0.03
    assert even == {"a": D("0.02"), "b": D("0.02")}  # 0.015 -> 0.02, 0.025 -> 0.02
