"""Mixing against a plain water-filling loop."""

from __future__ import annotations

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from basketry.llm import mixing as X
from basketry.llm import queries

from .util import SCHEMA, SF, edge_docs, edge_rows, empty_docs, row, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water(sizes: dict) -> dict:
    """Targets by sharing and resharing the excess."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, opened = 1.5 * sum(sizes.values()), {s: 0.0 for s in sizes}, set(sizes)
    while opened and left > 1e-9:
        share = left / sum(weight[s] for s in opened)
        full = {s for s in opened if target[s] + share * weight[s] >= 2 * sizes[s]}
        if not full:
            for s in opened:
                target[s] += share * weight[s]
            break
        for s in opened:
            new = min(2.0 * sizes[s], target[s] + share * weight[s])
            left -= new - target[s]
            target[s] = new
        opened -= full
    return target


def check(rows, sources):
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[sources(r)] += r.size
        taken[sources(r)] += r.taken
        assert r.taken in (0, r.size, 2 * r.size)
    want = water(sizes)
    for r in rows:
        assert r.source_size == sizes[sources(r)]
        assert r.target == pytest.approx(want[sources(r)], rel=1e-9, abs=1e-6)
    return sizes, taken, want


def test_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op6_source_mix(spark, SF).collect()
    assert all(r.size == len(WORD.findall(docs[r.doc_id].text or "")) for r in got) and len(got) == len(docs)
    sizes, taken, want = check(got, lambda r: docs[r.doc_id].source)
    # ten documents a source
    assert all(abs(taken[s] - want[s]) <= 0.15 * want[s] for s in sizes)
    again = queries.op6_source_mix(spark, SF).collect()
    assert sorted(got) == sorted(again)


def test_many_documents_come_near_the_target(spark):
    rows = [row(i, "w " * (1 + i * 7919 % 400), source="abcdefgh"[i % 8]) for i in range(1600)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = X.mix(docs).withColumn("taken", F.col("size") * F.col("copies"))
    _, taken, want = check(out.collect(), lambda r: r.source)
    assert all(abs(taken[s] - want[s]) < 0.02 * want[s] for s in want)


def test_edge_rows(spark):
    docs = edge_docs(spark)
    out = X.mix(docs)
    assert set(out.columns) == {*docs.columns, "size", "source_size", "target", "rate", "copies"}
    rows = out.withColumn("taken", F.col("size") * F.col("copies")).collect()
    assert len(rows) == len(edge_rows())
    check(rows, lambda r: r.source)
    assert X.mix(empty_docs(spark)).count() == X.mixed(empty_docs(spark)).count() == 0


def test_rows_without_words_or_ids(spark):
    docs = spark.createDataFrame([row(None, None, source=None), row(1, "", source="a"), row(None, " ", source="b")], SCHEMA)
    assert [(r.size, r.target, r.copies) for r in X.mix(docs).collect()] == [(0, 0.0, 0)] * 3


def test_mixed_emits_the_copies(spark):
    docs = edge_docs(spark)
    out = X.mixed(docs)
    assert out.columns == docs.columns
    want = sorted((str(r.doc_id), r.text or "") for r in X.mix(docs).collect() for _ in range(r.copies))
    assert sorted((str(r.doc_id), r.text or "") for r in out.collect()) == want


def test_sources_beyond_the_broadcast_bound(spark, monkeypatch):
    a = sorted((r.doc_id, r.copies) for r in queries.op6_source_mix(spark, SF).collect())
    monkeypatch.setattr(X, "BROADCAST_SOURCES", 0)
    assert a == sorted((r.doc_id, r.copies) for r in queries.op6_source_mix(spark, SF).collect())


def test_probability_of_a_copy(spark, monkeypatch):
    """Over many seeds a document is taken once more as often as its rate says (a source of few documents prefers seeds near its target)."""
    monkeypatch.setattr(X, "SEEDS", 1)
    docs = spark.createDataFrame([row(i, words(5 + i, i), source="ab"[i % 2]) for i in range(12)], SCHEMA)
    total, rate = defaultdict(int), {}
    n = 40
    for k in range(n):
        for r in X.mix(docs, weights=(3, 1), percent=75, seed=f"s{k}").collect():
            total[r.doc_id] += r.copies
            rate[r.doc_id] = r.rate
    assert all(abs(total[i] / n - rate[i]) < 0.35 for i in rate)
    assert abs(sum(total.values()) / n - sum(rate.values())) < 1.1


def test_draws_are_independent(spark):
    """Whether one document is taken once more says nothing about its neighbours: in size, in id, in both."""
    n = 4000
    docs = spark.createDataFrame([row(i, "w " * (1 + i % 40), source="a" if i % 2 else "b") for i in range(n)], SCHEMA)
    got = sorted((r.source, r.doc_id, r.copies - int(r.rate), r.rate - int(r.rate)) for r in X.mix(docs, weights=(1, 1), percent=70).collect())
    for s in "ab":
        x = [(c - p) for source, _, c, p in got if source == s]
        p = next(p for source, *_, p in got if source == s)
        assert 0 < p < 1
        for lag in (1, 2, 20):
            cov = sum(u * v for u, v in zip(x, x[lag:])) / len(x) / (p * (1 - p))
            assert abs(cov) < 4 / len(x) ** 0.5


def test_another_document_changes_no_draw_under_the_same_seed(spark, monkeypatch):
    monkeypatch.setattr(X, "SEEDS", 1)
    rows = [row(i, words(10, i)) for i in range(200)]
    a = {r.doc_id: r.copies for r in X.mix(spark.createDataFrame(rows, SCHEMA), weights=(1,), percent=50).collect()}
    b = {r.doc_id: r.copies for r in X.mix(spark.createDataFrame(rows[::-1][:150], SCHEMA), weights=(1,), percent=50).collect()}
    assert all(a[i] == b[i] for i in b)


def test_columns_of_any_name_survive(spark):
    names = ["size", "source_size", "target", "rate", "copies", "_copy", "_tie", "_block", "_blocks", "_source", "row", "a", "b", "of", "seed", "s1"]
    docs = spark.createDataFrame([(i, f"word {i}", "x", *[77] * len(names)) for i in range(20)], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    out = X.mixed(docs)
    assert out.columns == docs.columns and all(r[n] == 77 for r in out.collect() for n in names)
    new = X.mix(docs).collect()
    assert all(r.size == 2 and r.row == 77 and r.a == 77 for r in new) and len(new) == 20


def test_null_ids_are_drawn_one_by_one(spark):
    docs = spark.createDataFrame([row(None, words(20, i)) for i in range(600)], SCHEMA)
    got = X.mix(docs, weights=(1,), percent=50).collect()
    assert 200 < sum(r.copies for r in got) < 400
