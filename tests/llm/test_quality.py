"""The quality classifier: held-out accuracy, leakage, defined results."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.llm import pu_quality as X
from basketry.llm import queries

from .util import edge_docs, edge_rows, empty_docs

SF01 = "/root/testdata/sf0.1"


def auc(score, y):
    rank = np.empty(len(score))
    rank[np.argsort(score, kind="stable")] = np.arange(len(score))
    n = y.sum()
    return (rank[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    got = queries.op4_pu_quality(spark, SF01).collect()
    assert len(got) == spark.read.parquet(f"{SF01}/documents.parquet").count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    s, p, y = map(np.array, zip(*held))
    assert (p == y).mean() > 0.98 and auc(s, y) > 0.97
    assert p[y == 1].mean() > 0.99  # clean documents stay


def test_held_out_labels_change_nothing(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").limit(800)
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).cast("int"))
    a, b = (X.train(docs, x, max_positives=200, max_unlabelled=200) for x in (labels, flipped))
    assert (a.weights == b.weights).all() and a.bias == b.bias and a.prior == b.prior


def test_edge_rows_and_columns(spark):
    labels = spark.createDataFrame([(1, 1, None), (2, 0, 1), (None, 1, 0), (3, None, None), (1, 1, 1), (77, 1, 0)], "doc_id long, quality int, toxic int")
    docs = edge_docs(spark)
    got = X.quality(docs, labels).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r.score <= 1 for r in got)
    assert X.accepted(docs, labels).columns == docs.columns
    assert X.quality(empty_docs(spark), labels).count() == 0


def test_without_labels_the_prior_is_the_score(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = X.quality(edge_docs(spark), none).collect()
    assert {round(r.score, 6) for r in got} == {0.5}


def test_non_negative_risk_recovers_the_classes():
    """Two shifted clouds: the model separates them from positives and a mixture alone."""
    rng = np.random.default_rng(0)
    d = X.N_FEATURES
    shift = np.zeros(d)
    shift[:4] = 3
    p = rng.normal(size=(800, d))
    u = np.vstack([rng.normal(size=(1400, d)), rng.normal(size=(600, d)) + shift])
    m = X.fit(p, u, 0.7)
    s = m.score(np.vstack([rng.normal(size=(300, d)), rng.normal(size=(300, d)) + shift]))
    y = np.r_[np.ones(300), np.zeros(300)]
    assert auc(s, y) > 0.97 and s[:300].mean() > s[300:].mean() + 0.3


def test_positives_alone_as_labels(spark):
    """Without any label 0 the classes still part: the prior comes from positives and unlabelled text."""
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = X.quality(spark.read.parquet(f"{SF01}/documents.parquet"), labels.where("quality = 1")).collect()
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert sum(p == y for p, y in held) / len(held) > 0.95


def test_labels_for_every_document(spark):
    """Then the labelled rows stand in as unlabelled: label 0 texts are still told apart."""
    labels = spark.read.parquet(f"{SF01}/labels.parquet").where("quality in (0, 1)")
    docs = spark.read.parquet(f"{SF01}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = [(r.predicted, truth[r.doc_id]) for r in X.quality(docs, labels).collect() if r.held_out]
    assert sum(p == y for p, y in got) / len(got) > 0.95


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_the_prior_is_estimated_from_positives_and_unlabelled_rows(share):
    rng = np.random.default_rng(3)
    d = X.N_FEATURES
    shift = np.zeros(d)
    shift[:5] = 3
    n = int(4000 * share)
    u = np.vstack([rng.normal(size=(n, d)), rng.normal(size=(4000 - n, d)) + shift])
    got = X.estimated_prior(rng.normal(size=(1500, d)), rng.permutation(u))
    assert abs(got - share) < 0.06


def test_features_against_a_plain_count():
    import re

    import pyarrow as pa

    from basketry.llm.common import utf8

    texts = ["One one two, two two three!", "x", "a-b  c\n\n12 12", "é Ü é"]
    got = X.features(*utf8(pa.array(texts)))
    for x, t in zip(got, texts):
        raw = t.encode()
        words = re.findall(rb"[^\x20\x09-\x0D]+", raw.lower())
        half = X.N_FEATURES // 2
        assert x[X._CLASS[ord(" ")]] == pytest.approx(raw.count(b" ") / len(raw))
        assert x[X._CLASS[ord("a")]] == pytest.approx(sum(97 <= c <= 122 for c in raw) / len(raw))
        more = x[X.N_CLASSES : half]
        pairs = list(zip(words, words[1:]))
        mean = np.mean([len(w) for w in words])
        want = [
            sum(a == b for a, b in pairs) / len(words), 1 - len(set(words)) / len(words), np.log1p(len(set(words))) / np.log1p(len(words)),
            max(words.count(w) for w in words) / len(words), 1 - (len(set(pairs)) if pairs else 1) / max(len(words) - 1, 1), mean / 20, np.std([len(w) for w in words]) / 20, np.log1p(len(words)) / 10,
        ]
        assert np.allclose(more, want) and np.allclose(x[half:], np.sqrt(np.maximum(x[:half], 0)))


def test_risk_against_its_formula():
    rng = np.random.default_rng(5)
    p, u, w = rng.normal(size=(7, 3)), rng.normal(size=(9, 3)), rng.normal(size=3)
    loss = lambda g: float(np.log(1 + np.exp(-g)))
    positive = 0.4 * sum(loss(x @ w) for x in p) / 7
    negative = sum(loss(-(x @ w)) for x in u) / 9 - 0.4 * sum(loss(-(x @ w)) for x in p) / 7
    assert np.allclose(X.risk(w, p, u, 0.4), (positive, negative))
    m = X._minimised(p, u, 0.4, rounds=400)
    z = [np.c_[np.clip((x - m.mean) / m.scale, -8, 8), np.ones(len(x))] for x in (p, u)]
    found = np.r_[m.weights, m.bias]
    total = lambda v: X.risk(v, *z, 0.4)[0] + max(0.0, X.risk(v, *z, 0.4)[1])
    assert total(found) < total(np.r_[np.zeros(3), np.log(0.4 / 0.6)])


def test_columns_of_any_name_survive(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "text", 5, 6, 7)], "doc_id long, text string, score int, _score int, score_ int")
    assert [tuple(r) for r in X.accepted(docs, labels).collect()] == [(1, "text", 5, 6, 7)]


def test_features_do_not_depend_on_neighbours():
    import pyarrow as pa

    from basketry.llm.common import utf8

    texts = ["a b c", "", "Hello!! WORLD ##", None, "é ü 12 12 12"]
    joint = X.features(*utf8(pa.array(texts)))
    for i, t in enumerate(texts):
        assert np.allclose(joint[i], X.features(*utf8(pa.array([t], pa.string())))[0])
    assert not joint[1].any() and not joint[3].any()
