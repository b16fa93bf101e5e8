"""Long selections, sketches of distinct persons, bins of a readable width."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal as D

import pytest

from basketry.operators import aggregates as A
from basketry.operators import filters as FL
from basketry.operators import metrics as K


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_short_selections_are_predicates_and_long_ones_joins(spark, tmp_path):
    spark.range(1000).selectExpr("id", "concat('c', id) AS category").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    short = FL.in_values(df, "category", ["c1", "c2", None, "c1"])
    assert "PushedFilters: [In(category" in plan(short)
    assert sorted(r.id for r in short.collect()) == [1, 2]
    long = FL.in_values(df, "category", [f"c{i}" for i in range(0, 200_000, 2)] + [None])
    text = plan(long)
    assert "LeftSemi" in text and " IN (" not in text and "INSET" not in text and len(text) < 20_000
    assert sorted(r.id for r in long.collect()) == list(range(0, 1000, 2))
    assert FL.in_values(df, "category", []).count() == 0


def test_long_selections_shuffle_when_they_are_large(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = FL.in_values(spark.range(5000), "id", range(0, 100_000, 5))
        assert "BroadcastHashJoin" not in plan(df) and df.count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def retention(spark, n=4000):
    r = random.Random(1)
    rows = [(dt.datetime(2017, 1 + r.randrange(12), 1 + r.randrange(28)), f"p{int(r.paretovariate(0.6)) % 3000}" if i % 50 else None) for i in range(n)]
    return rows, spark.createDataFrame(rows, "most_recent_purchase_at timestamp_ntz, customer_unique_id string")


def test_sketches_merge(spark):
    """The union of the months' sketches says the same as one sketch of all rows, within the bound of the exact count."""
    rows, df = retention(spark)
    months = K.person_sketches(df)
    assert months.count() == 12
    got = K.persons_of(months).first()
    exact = len({p for _, p in rows if p is not None})
    assert got.orders == len(rows) and abs(got.persons - exact) <= K.SKETCH_ERROR * exact
    one = K.persons_of(K.person_sketches(df.selectExpr("timestamp_ntz'2017-01-01' AS most_recent_purchase_at", "customer_unique_id"))).first()
    assert abs(one.persons - got.persons) <= 1
    quarter = K.persons_of(months.where("order_month < date'2017-04-01'")).first()
    exact = len({p for t, p in rows if p is not None and t.month < 4})
    assert abs(quarter.persons - exact) <= K.SKETCH_ERROR * exact + 1


def test_a_new_month_needs_no_scan_of_the_others(spark):
    rows, df = retention(spark)
    old, new = K.person_sketches(df.where("month(most_recent_purchase_at) < 12")), K.person_sketches(df.where("month(most_recent_purchase_at) = 12"))
    both = K.persons_of(old.unionByName(new)).first()
    assert (both.orders, both.persons) == tuple(K.persons_of(K.person_sketches(df)).first())


@pytest.mark.parametrize(
    ("values", "most", "width"),
    [([0, 99], 50, D(2)), ([0, 100], 50, D(5)), ([-7, 7], 15, D(1)), ([-7, 7], 14, D(2)), ([3], 10, D(1)), ([], 10, D(1)), ([0, D("0.35")], 200, D("0.002")), ([0, 10**6], 7, D(200_000)), ([D("-0.5"), D("0.5")], 3, D("0.5"))],
)
def test_nice_width(spark, values, most, width):
    df = spark.createDataFrame([(D(v),) for v in values], "x decimal(18,4)")
    assert A.nice_width(df, "x", most) == width


@pytest.mark.parametrize("seed", range(4))
def test_nice_bins_are_the_least_that_fit(spark, seed):
    r = random.Random(seed)
    values = [D(r.randint(-(10**seed), 10 ** (seed + 2))) / 100 for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "x decimal(18,2)")
    most = r.choice([5, 20, 50])
    got = A.nice_histogram(df, "x", most).collect()
    assert sum(b["count"] for b in got) == len(values) and max(b.bin for b in got) - min(b.bin for b in got) < most
    for b in got:
        assert b["count"] == sum(b.bin_start <= v < b.bin_end for v in values)
    lo, hi, w = min(values), max(values), got[0].bin_end - got[0].bin_start
    smaller = {1: D("0.5"), 2: D(1), 5: D(2)}[int(str(w.normalize().as_tuple().digits[0]))].scaleb(w.normalize().adjusted())
    assert (hi / smaller).to_integral_value("ROUND_FLOOR") - (lo / smaller).to_integral_value("ROUND_FLOOR") + 1 > most
