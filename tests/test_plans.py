"""Plan-shape regression tests: the physical plans keep the properties that matter at scale."""

from __future__ import annotations

import os
import re

import pytest

import __spark_entry__ as E
from basketry.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")

# Queries that write or read scratch tables as part of the operator; their plans are scans.
SIDE_EFFECT = {"ingest_csv", "ingest_all", "build_all", "raw_roundtrip", "load_report", "mart_roundtrip", "mart_scan", "mart_category_year", "mart_reuse", "table_versions", "ingest_rejects", "build_bucketed"}
# Queries whose work is the forest (fit happens eagerly); checked in test_anomaly.
FOREST = {"isolation_forest", "anomaly_labels", "kpi_anomalies", "audit_view", "dq_same_count", "anomaly_split", "kpi_items_analyzed", "audit_columns", "outlier_map", "anomaly_min_rows_bound"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _windows(p: str) -> list[str]:
    return [line for line in p.splitlines() if re.search(r"\bWindow \[", line)]


@pytest.mark.parametrize("key", sorted(set(catalog.queries()) - SIDE_EFFECT - FOREST))
def test_no_cartesian_and_no_unbucketed_window(spark, key):
    p = plan(E.queries()[key](spark, SF))
    assert "CartesianProduct" not in p
    for w in _windows(p):
        # the partition spec is the second bracket group of a Window node: a (key, bucket)
        # pair, the per-key bucket summary (one row per bucket) or the forest's tree id
        spec = re.findall(r"\[([^\[\]]*)\]", w)
        assert len(spec) >= 2 and any(t in spec[1] for t in ("__bkt", "__key", "tree#")), w


def test_fct_orders_one_exchange_per_side(spark):
    p = plan(E.queries()["fct_orders"](spark, SF))
    assert p.count("Exchange hashpartitioning") == 2
    assert p.count("SortMergeJoin") + p.count("BroadcastHashJoin") == 2  # order join + part price lookup


def test_scans_are_pruned_and_filters_pushed(spark):
    p = plan(E.queries()["monthly_revenue"](spark, SF))
    for read in re.findall(r"ReadSchema: struct<([^>]*)>", p):
        assert "l_returnflag" not in read and "l_quantity" not in read and "o_totalprice" not in read
    # the events' mapping is written once: the filter is in the plan that writes it
    from basketry.sources import fixtures

    e = plan(fixtures.purchase_events(spark, SF))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(event_type,purchase\)", e)


def test_retention_window_is_bucketed(spark):
    # with no heavy key the bucket is the constant 0 and folds away (every group is then
    # below heavyRows); force heavy keys to see the (key, bucket) partitioning
    spark.conf.set("basketry.skew.heavyRows", "5")
    spark.conf.set("basketry.skew.bucketRows", "3")
    try:
        p = plan(E.queries()["customer_retention"](spark, SF))
    finally:
        spark.conf.unset("basketry.skew.heavyRows")
        spark.conf.unset("basketry.skew.bucketRows")
    assert any("__bkt" in w for w in _windows(p))
    assert "BroadcastNestedLoopJoin" in p  # the one-row dataset max, broadcast by construction


def test_year_selection_prunes_partitions(spark):
    p = plan(E.queries()["mart_category_year"](spark, SF))
    assert re.search(r"PartitionFilters: \[[^\]]*revenue_year", p)


def _scanned(df) -> list[str]:
    """Tables of the driver's data that a plan scans, one entry a scan (a reused exchange scans nothing)."""
    text = plan(df).split("== Initial Plan ==")[0]
    return re.findall(rf"Location: InMemoryFileIndex[^\n]*?{SF}/(\w+)\.parquet", text)


@pytest.mark.parametrize(("key", "frame", "fact"), [("customer_retention", "order-mapping", "orders"), ("product_cost_decomposition", "product-base", "lineitem")])
def test_shared_frames_are_written_once(spark, monkeypatch, key, frame, fact):
    """Samples, maxima, benchmarks and the mart itself read the written frame: sources are scanned for that alone."""
    from basketry.operators import marts, shared

    written, real = {}, shared.written_once

    def seen(df, name):
        written[name] = written.get(name, []) + [_scanned(df)]
        return real(df, name)

    monkeypatch.setattr(marts, "written_once", seen)
    out = E.queries()[key](spark, SF)
    assert len(written[frame]) == 1 and written[frame][0].count(fact) == 1
    assert fact not in _scanned(out)


def test_bucketed_joins_have_no_exchange(spark, tmp_path):
    """The fact and the bridge meet bucket by bucket in both joins; the marts are those of a build without buckets."""
    from basketry.operators import aggregates, marts
    from basketry.plans.build import build
    from basketry.plans.catalog import Models

    m = Models(spark, SF)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        models = build(m.raw, root=str(tmp_path / "a"), select=["dim_customer", "customer_retention"], buckets=4)
        mapping = plan(marts.order_mapping(models["fct_orders"], models["stg_customer"]))
        assert "SortMergeJoin" in mapping and "Exchange" not in mapping and "SelectedBucketsCount: 4 out of 4" in mapping
        stats = plan(aggregates.customer_stats(models["fct_orders"], models["stg_customer"]))
        assert "SortMergeJoin" in stats and "Exchange hashpartitioning(customer_id" not in stats
        plain = build(m.raw, root=str(tmp_path / "b"), select=["dim_customer", "customer_retention"])
        for name in ("dim_customer", "customer_retention"):
            assert sorted(map(tuple, models[name].collect()), key=str) == sorted(map(tuple, plain[name].collect()), key=str)
        again = build(m.raw, root=str(tmp_path / "a"), select=["dim_customer"], buckets=4)
        assert again["fct_orders"].count() == plain["fct_orders"].count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_table_without_buckets_is_told(spark, tmp_path):
    from basketry.sources.bucketed import read_bucketed
    from basketry.sources.files import write_table

    write_table(spark.range(3), str(tmp_path), "raw", "t")
    with pytest.raises(ValueError, match="no buckets"):
        read_bucketed(spark, str(tmp_path), "raw", "t")
