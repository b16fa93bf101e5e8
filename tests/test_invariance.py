"""Every mart gives the same rows whatever the partitioning (SURVEY §5 (5))."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
MARTS = [
    "fct_orders", "dim_products", "dim_customer", "monthly_revenue", "monthly_revenue_by_cat",
    "product_cost_decomposition", "customer_retention",
]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
@pytest.mark.parametrize("mart", MARTS)
def test_mart_invariant_to_partitioning(spark, mart):
    q = E.queries()[mart]
    results = []
    for parts, aqe, heavy in [("1", "false", None), ("7", "true", None), ("5", "true", "20")]:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
        if heavy:
            spark.conf.set("basketry.skew.heavyRows", heavy)
            spark.conf.set("basketry.skew.bucketRows", "7")
        try:
            results.append(sorted(map(tuple, q(spark, SF).collect()), key=repr))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.set("spark.sql.adaptive.enabled", "true")
            spark.conf.unset("basketry.skew.heavyRows")
            spark.conf.unset("basketry.skew.bucketRows")
    assert results[0] == results[1] == results[2]
