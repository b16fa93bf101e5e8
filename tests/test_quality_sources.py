from __future__ import annotations

import os
from decimal import Decimal as D

from basketry.operators import quality as Q
from basketry.sources import files as FS


def test_each_check_catches_its_violation_and_ignores_nulls(spark):
    df = spark.createDataFrame(
        [(1, "a", 5, D("1.0")), (1, "b", -1, D("-2.0")), (None, "zz", None, None), (None, None, 3, D("3.0"))],
        "id int, label string, n int, gap decimal(18,2)",
    )
    assert [r.id for r in Q.check_unique(df, "id").collect()] == [1]  # NULL ids are not duplicates
    assert Q.check_not_null(df, "id").count() == 2
    assert {r.label: r.n_records for r in Q.check_accepted(df, "label", ["a", "b"]).collect()} == {"zz": 1}
    assert [r.n for r in Q.check_range(df, "n", min_value=0).collect()] == [-1]
    assert Q.check_range(df, "n", min_value=5, inclusive=False).count() == 3
    assert [r.id for r in Q.check_expr(df, "gap", ">= 0", "n > 0").collect()] == []
    assert [r.n for r in Q.check_expr(df, "gap", ">= 0").collect()] == [-1]
    same = Q.check_same_count(df, df.limit(3)).first()
    assert (same.left_rows, same.right_rows, same.same) == (4, 3, False)


def test_run_checks_summary(spark):
    fct = spark.createDataFrame([(1,), (1,), (None,)], "order_id int")
    ret = spark.createDataFrame(
        [("x", 1, 1, "New (Potential Repeat)", None), ("x", 2, 0, "Oops", D("-1.00"))],
        "customer_unique_id string, order_id int, order_sequence int, lifecycle_stage string, days_between_orders decimal(18,2)",
    )
    out = {(r.model, r.column_name, r.test_name): (r.failures, r.status) for r in Q.run_checks({"fct_orders": fct, "customer_retention": ret}).collect()}
    assert out[("fct_orders", "order_id", "unique")] == (1, "fail")
    assert out[("fct_orders", "order_id", "not_null")] == (1, "fail")
    assert out[("customer_retention", "order_sequence", "accepted_range")] == (1, "fail")
    assert out[("customer_retention", "lifecycle_stage", "accepted_values")] == (1, "fail")
    assert out[("customer_retention", "days_between_orders", "expression_is_true")] == (0, "pass")
    assert out[("customer_retention", "order_id", "unique")] == (0, "pass")
    assert len(out) == 9  # only checks of the given tables


def test_declared_suite_size():
    tests = [c.test for c in Q.CHECKS]
    assert len(tests) == 28
    assert {t: tests.count(t) for t in set(tests)} == {
        "unique": 7, "not_null": 15, "accepted_values": 3, "accepted_range": 2, "expression_is_true": 1}


def test_ingest_dir_and_normalisation(spark, tmp_path):
    d = tmp_path / "data"
    d.mkdir()
    (d / "shop_sellers_dataset.csv").write_text("Seller Id,seller.zip code prefix,seller_city,seller_state\ns1,01234,rio,RJ\n")
    (d / "product_category_name_translation.csv").write_text(
        "product_category_name,product_category_name_english\nbeleza,beauty\n")
    (d / "notes.txt").write_text("ignored")
    tables = FS.ingest_dir(spark, str(d), prefix="shop_")
    assert set(tables) == {"sellers", "product_category_name_translation"}
    s = tables["sellers"].first()
    assert tables["sellers"].columns == ["seller_id", "seller_zip_code_prefix", "seller_city", "seller_state"]
    assert s.seller_zip_code_prefix == "01234"  # declared string: leading zero kept
    assert FS.ingest_dir(spark, str(tmp_path / "missing")) == {}
    assert FS.table_name_for("shop_order_items_dataset.csv", "shop_") == "order_items"
    assert FS.normalize_name("Customer Zip.Code") == "customer_zip_code"


def test_write_table_counts_during_write_and_overwrites(spark, tmp_path):
    root = str(tmp_path / "wh")
    df = spark.range(10)
    assert FS.write_table(df, root, "raw", "t") == 10
    assert FS.write_table(spark.range(3), root, "raw", "t") == 3
    assert FS.read_table(spark, root, "raw", "t").count() == 3
    assert os.path.isdir(os.path.join(root, "raw", "t"))
    rep = FS.load_tables({"a": spark.range(2), "b": spark.range(5)}, root)
    assert sorted(rep.collect()) == [("a", 2), ("b", 5)]


def test_accepted_values_counts_distinct_offenders(spark):
    pcd = spark.createDataFrame(
        [(1, "Bad", True), (2, "Bad", None), (3, "Worse", False), (4, "Single Sale", True), (5, None, False)],
        "product_id int, reliability_score string, is_price_rebalanced boolean",
    )
    cols = ("reliability_score", "product_id", "is_price_rebalanced")
    checks = [c for c in Q.CHECKS if c.model == "product_cost_decomposition" and c.column in cols]
    out = {(r.column_name, r.test_name): r.failures for r in Q.run_checks({"product_cost_decomposition": pcd}, checks).collect()}
    assert out[("reliability_score", "accepted_values")] == 2
    assert out[("is_price_rebalanced", "accepted_values")] == 0 and out[("is_price_rebalanced", "not_null")] == 1
    assert out[("product_id", "unique")] == 0 and out[("product_id", "not_null")] == 0


def test_build_levels_respect_dependencies():
    from basketry.plans.build import MARTS, _closure, _levels

    levels = _levels(_closure(MARTS))
    assert levels[0] == ["fct_orders", "dim_products", "monthly_revenue_by_cat"]
    assert set(levels[1]) == {"dim_customer", "monthly_revenue", "product_cost_decomposition", "customer_retention"}
    assert _levels(_closure(["monthly_revenue"])) == [["fct_orders"], ["monthly_revenue"]]


def test_ingest_fails_fast_on_malformed_rows(spark, tmp_path):
    import pytest as _pytest

    d = tmp_path / "bad"
    d.mkdir()
    (d / "order_items.csv").write_text(
        "order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\n"
        "o1,1,p1,s1,2018-01-01 00:00:00,10.50,1.00\n"
        "o2,not-a-number,p2,s1,2018-01-01 00:00:00,abc,1.00\n"
    )
    tables = FS.ingest_dir(spark, str(d))
    with _pytest.raises(Exception):
        tables["order_items"].collect()


def test_suite_catches_violations_seeded_into_built_marts(spark):
    import os

    from pyspark.sql import functions as F

    from basketry.plans.catalog import Models

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        return
    m = Models(spark, sf)
    clean = {r.test_name + ":" + r.model + "." + r.column_name: r.failures
             for r in Q.run_checks({"fct_orders": m.fct, "customer_retention": m.retention}).collect()}
    assert all(v == 0 for v in clean.values())
    fct = m.fct.unionByName(m.fct.limit(1))  # one duplicated order id
    ret = m.retention.select(
        F.when(F.col("order_sequence") == 1, F.lit(None)).otherwise(F.col("customer_unique_id")).alias("customer_unique_id"),
        *[c for c in m.retention.columns if c not in ("customer_unique_id", "lifecycle_stage", "days_between_orders")],
        F.when(F.col("order_sequence") == 2, F.lit("Oops")).otherwise(F.col("lifecycle_stage")).alias("lifecycle_stage"),
        F.when(F.col("order_sequence") == 3, -F.col("days_between_orders")).otherwise(F.col("days_between_orders")).alias(
            "days_between_orders"),
    )
    got = {r.test_name + ":" + r.model + "." + r.column_name: (r.failures, r.status)
           for r in Q.run_checks({"fct_orders": fct, "customer_retention": ret}).collect()}
    assert got["unique:fct_orders.order_id"] == (1, "fail")
    assert got["not_null:customer_retention.customer_unique_id"][1] == "fail"
    assert got["accepted_values:customer_retention.lifecycle_stage"] == (1, "fail")
    assert got["expression_is_true:customer_retention.days_between_orders"][1] == "fail"
    assert got["not_null:fct_orders.order_id"] == (0, "pass")
