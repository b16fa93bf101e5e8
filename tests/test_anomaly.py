from __future__ import annotations

import hashlib
import math
import random

import pytest

from basketry.operators import forest
from basketry.operators.anomaly import FEATURES, detect_anomalies, fit_isolation_forest, isolation_forest_scores


def _products(spark, n=300, outliers=5, seed=3):
    rnd = random.Random(seed)
    data = []
    for i in range(n):
        z, cv, fs = rnd.gauss(0, 1), abs(rnd.gauss(0.1, 0.02)), rnd.gauss(10, 1)
        data.append((i, z, cv, fs, "High Confidence", True))
    for j in range(outliers):
        data.append((n + j, 25.0 + j, 3.0, 90.0, "High Confidence", False))
    data.append((n + outliers, None, None, None, "Single Sale", False))
    return spark.createDataFrame(
        data,
        "product_id bigint, total_cost_z_score double, total_cost_cv double, freight_share_pct double, "
        "reliability_score string, is_revenue_workhorse boolean",
    )


def brute_scores(rows, trees, psi, seed):
    """The forest of ``rows`` {key: features}, tree by tree and node by node."""

    def md5(*parts):
        return hashlib.md5("\x01".join(map(str, parts)).encode()).hexdigest()

    n, p, wanted = len(rows), 2_147_483_647, 3 * trees * psi
    psi = min(psi, n)
    wanted = 3 * trees * psi
    row_gate, tree_gate = min(2**32, wanted * 2**32 // n), min(p, 3 * psi * p // min(n, wanted))
    hashes = {}
    for k in rows:
        d = md5("row", seed, k)
        if int(d[16:24], 16) < row_gate:
            hashes[k] = (int(d[:8], 16) % p, int(d[8:16], 16) % p)
    height = max(psi - 1, 1).bit_length()
    total, c = dict.fromkeys(rows, 0), 0
    for t in range(trees):
        order = sorted((h, k) for k, (a, b) in hashes.items() if (h := (a * (t + 1) + b) % p) < tree_gate)[:psi]
        c += forest.mean_path(len(order))
        nodes = {}

        def grow(node, own, depth):
            wide = [i for i in range(3) if own and max(x[i] for x in own) > min(x[i] for x in own)]
            if depth == height or not wide:
                nodes[node] = (None, depth * 2**32 + forest.mean_path(len(own)))
                return
            d = md5("node", seed, t, node)
            f = wide[int(d[:8], 16) % len(wide)]
            lo, hi = min(x[f] for x in own), max(x[f] for x in own)
            cut = lo + int(d[8:20], 16) / float(1 << 48) * (hi - lo)
            cut = lo if cut >= hi else cut
            nodes[node] = (f, cut)
            grow(2 * node, [x for x in own if x[f] <= cut], depth + 1)
            grow(2 * node + 1, [x for x in own if x[f] > cut], depth + 1)

        grow(1, [rows[k] for _, k in order], 0)
        for k, x in rows.items():
            node = 1
            while nodes[node][0] is not None:
                node = 2 * node + (x[nodes[node][0]] > nodes[node][1])
            total[k] += nodes[node][1]
    return {k: math.floor(2.0 ** -(float(v) / float(max(c, 1))) * 1e9 + 0.5) / 1e9 for k, v in total.items()}


def test_mean_path():
    assert [forest.mean_path(n) for n in (0, 1, 2)] == [0, 0, 2**32]
    # the usual approximation by a logarithm
    assert math.isclose(forest.mean_path(256) / 2**32, 2 * (math.log(255) + 0.5772156649) - 2 * 255 / 256, rel_tol=1e-3)
    assert [forest.height_of(n) for n in (1, 2, 3, 4, 5, 256, 257)] == [1, 1, 2, 2, 3, 8, 9]


@pytest.mark.parametrize(("n", "trees", "psi"), [(120, 7, 32), (400, 3, 16), (5, 4, 256), (1, 2, 8)])
def test_scores_equal_a_tree_by_tree_forest(spark, n, trees, psi):
    """Few and many rows, with the gates open and half closed, and rows that repeat all features."""
    rnd = random.Random(n)
    rows = {i: [rnd.gauss(0, 1), float(rnd.randint(0, 2)), 0.5] if i % 5 else [0.0, 0.0, 0.5] for i in range(n)}
    df = spark.createDataFrame([(k, *x) for k, x in rows.items()], "product_id bigint, " + ", ".join(f"{f} double" for f in FEATURES))
    got = isolation_forest_scores(df, trees=trees, psi=psi, seed=9)
    assert {r.product_id: r.anomaly_score for r in got.collect()} == brute_scores(rows, trees, psi, 9)


def test_no_python_worker_in_the_plans(spark):
    plan = detect_anomalies(_products(spark))._jdf.queryExecution().executedPlan().toString()
    nodes, psi = fit_isolation_forest(_products(spark), trees=5, psi=32)
    feats = _products(spark).select("product_id", *FEATURES)
    lazy = forest.fit(feats, FEATURES, "product_id", 306, 5, 32, 1)._jdf.queryExecution().executedPlan().toString()
    walk = forest.scored(feats, nodes, FEATURES, "product_id", 5, psi)._jdf.queryExecution().executedPlan().toString()
    for text in (plan, lazy, walk):
        assert "Python" not in text and "Pandas" not in text and "Arrow" not in text
    assert lazy.count("Exchange") == 1  # the levels follow without another shuffle


def test_ties_at_the_cut_are_normal(spark):
    df = spark.createDataFrame([(i, 1.0, 1.0, 1.0) for i in range(40)] + [(40, 9.0, 9.0, 9.0)], "product_id bigint, " + ", ".join(f"{f} double" for f in FEATURES))
    got = {r.product_id for r in isolation_forest_scores(df, contamination=0.3).collect() if r.is_anomaly}
    assert got == {40}


def test_planted_outliers_are_found(spark):
    df = _products(spark)
    lab = detect_anomalies(df, contamination=0.02)
    got = {r.product_id: r.Result for r in lab.collect()}
    assert lab.count() == df.count()
    assert all(got[300 + j] == "Anomaly" for j in range(5))
    assert got[305] == "Single sale - No Analysis"
    n_anom = sum(v == "Anomaly" for v in got.values())
    n_scored = 305
    assert n_anom == math.ceil((n_scored - 1) * 0.02) or abs(n_anom - n_scored * 0.02) <= 1


def test_same_result_under_repartitioning(spark):
    df = _products(spark).where("reliability_score <> 'Single Sale'")
    ref = None
    for parts in (1, 4, 16):
        s = isolation_forest_scores(df.repartition(parts), contamination=0.05)
        got = sorted((r.product_id, round(r.anomaly_score, 12), r.is_anomaly) for r in s.collect())
        if ref is None:
            ref = got
        assert got == ref


def test_forest_is_bounded_by_parameters(spark):
    nodes, psi = fit_isolation_forest(_products(spark), trees=10, psi=64)
    assert psi == 64 and nodes.select("tree").distinct().count() == 10
    assert max(r["count"] for r in nodes.groupBy("tree").count().collect()) <= 2**7 - 1


def test_trees_are_fitted_by_several_tasks(spark):
    """The node table keeps the partitions that its trees were fitted in, each tree in one of them."""
    from pyspark.sql import functions as F

    nodes, _ = fit_isolation_forest(_products(spark), trees=40, psi=16)
    assert nodes.rdd.getNumPartitions() == min(40, spark.sparkContext.defaultParallelism) > 1
    at = nodes.select("tree", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(at) == 40 and len({r.p for r in at}) > 1


def test_min_rows_guard(spark):
    small = _products(spark, n=9, outliers=1)  # 10 trainable rows < 11
    lab = detect_anomalies(small, contamination=0.1)
    assert {r.Result for r in lab.collect()} == {"Single sale - No Analysis"}


def test_exact_quantile_equals_percentile(spark):
    from pyspark.sql import functions as F

    from basketry.operators.quantile import exact_quantile

    rnd = random.Random(5)
    sets = [
        [rnd.gauss(0, 1) for _ in range(5001)] + [0.25] * 900,
        [1e300, -1e300, 1e-300, 0.0, 5.0, math.nextafter(5.0, 6.0), math.nextafter(5.0, 6.0)],
        [3.0] * 40,
        [7.0],
        [rnd.expovariate(1) ** 9 for _ in range(800)],
    ]
    for values in sets:
        df = spark.createDataFrame([(v,) for v in [*values, None]], "x double").repartition(4).cache()
        for q in (0.0, 0.01, 0.05, 0.5, 0.777, 0.95, 1.0):
            want = df.agg(F.percentile("x", q)).first()[0]
            got = exact_quantile(df, "x", q)
            assert math.isclose(got, want, rel_tol=1e-12, abs_tol=1e-300), (q, got, want)
    assert exact_quantile(spark.createDataFrame([], "x double"), "x", 0.5) is None
