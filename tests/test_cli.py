"""End to end: source CSV files -> raw tier -> marts -> declared checks (load, build, test)."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from basketry.__main__ import build_and_check, ingest, report
from basketry.sources import fixtures as FX
from basketry.sources.files import read_mart

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_ingest_build_check(spark, tmp_path):
    csv = tmp_path / "csv"
    raw = FX.raw_tables(spark, SF)
    for name in ("orders", "order_items", "customers", "products", "sellers", "product_category_name_translation"):
        df = raw[name]
        df.select(*[F.col(c).cast("string") for c in df.columns]).coalesce(1).write.option("header", True).csv(
            str(csv / f"shop_{name}_dataset.csv")
        )
    root = str(tmp_path / "wh")
    assert ingest(spark, str(csv), root, prefix="shop_") == 6
    assert build_and_check(spark, root)
    fct = read_mart(spark, root, "fct_orders")
    assert fct.count() == raw["orders"].count()
    assert read_mart(spark, root, "customer_retention", ["order_id"]).count() == fct.count()
    rep = report(spark, root, categories=["STANDARD goods", "Unknown"], years=[1996, 1997], contamination=0.1)
    assert rep["customers"][0].total_customers > 0
    assert rep["anomalies"][0].items_analyzed > 0
    assert {r.revenue_year for r in rep["yearly_avg_revenue"]} <= {1996, 1997}
    assert sum(r.orders for r in rep["lifecycle"]) == fct.count()
