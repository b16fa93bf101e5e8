"""The pipeline: each stage against brute force over its own input."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline as P
import pytest

from basketry.llm.common import written
from basketry.llm.pu_quality import scored, train
from basketry.llm.secrets import Scanner, replace

from .test_hyperminhash import brute as groups
from .test_mixing import water
from .test_tokens import ids
from .util import SF, SCHEMA, edge_docs, empty_docs, sha


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        out.append(written(stage(spark, out[-1], SF), name))
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_columns_stay_until_the_last_stage(steps):
    assert all(x.columns == steps[0].columns and x.schema == steps[0].schema for x in steps[1:-1])
    assert steps[-1].columns == ["doc_id", "lang", "source", "n_chars", "ids", "n_tokens", "decoded_sha256"]


def test_quality_stage(spark, steps):
    model = train(steps[0], spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in scored(steps[0], model).collect() if r.score >= 0.3}
    assert {r.doc_id for r in steps[1].collect()} == want and 0 < len(want) < steps[0].count()


def test_dedup_stage(steps):
    before = {r.doc_id: r.text for r in steps[1].collect()}
    top = groups(before.items(), 5, 80)
    assert rows(steps[2]) == [r for r in rows(steps[1]) if top[r[0]] == r[0]]


def test_secret_stage(steps):
    scanner = Scanner()
    want = []
    for r in steps[2].collect():
        t = replace(r.text, scanner.spans(r.text)[1], "[SECRET]")
        want.append((r.doc_id, t, r.lang, r.source, len(t) if t != r.text else r.n_chars))
    assert rows(steps[3]) == sorted(want, key=str)


def test_mixing_stage(steps):
    before = {r.doc_id: r for r in steps[3].collect()}
    size = {i: len(r.text.split()) for i, r in before.items()}
    total, largest = Counter(), Counter()
    for i, r in before.items():
        total[r.source] += size[i]
        largest[r.source] = max(largest[r.source], size[i])
    got = Counter(r.doc_id for r in steps[4].collect())
    taken = Counter()
    for i, n in got.items():
        assert n <= 2
        taken[before[i].source] += n * size[i]
    for s, t in water(dict(total)).items():
        assert abs(taken[s] - t) <= max(0.1 * t, largest[s])
    assert all(tuple(r) == tuple(before[r.doc_id]) for r in steps[4].collect())


def test_encoding_stage(steps):
    text = {r.doc_id: r.text for r in steps[4].collect()}
    got = steps[5].collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in steps[4].collect())
    assert all(list(r.ids) == ids(text[r.doc_id]) and r.n_tokens == len(r.ids) for r in got)
    assert all(r.decoded_sha256 == sha(text[r.doc_id]) for r in got)


def test_encoding_runs_one_python_stream_a_task(spark, steps):
    """No partitions are put together above a Python step, and the stage gives the same rows again and again."""
    stage = dict(P.STAGES)["bpe_encoding"]
    for name in ("quality_classifier", "secret_scans", "bpe_encoding"):
        plan = dict(P.STAGES)[name](spark, steps[0], SF)._jdf.queryExecution().executedPlan().toString()
        assert "Coalesce" in plan and plan.rindex("MapInArrow") < plan.index("Coalesce")
    first = rows(stage(spark, steps[4], SF).select("doc_id", "decoded_sha256"))
    assert all(rows(stage(spark, steps[4], SF).select("doc_id", "decoded_sha256")) == first for _ in range(5))


def test_run_gives_the_last_stage(spark, steps):
    assert rows(P.run(spark, SF).select("doc_id", "n_tokens")) == rows(steps[-1].select("doc_id", "n_tokens"))


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_stages_on_edge_rows_and_empty_tables(spark, name, stage):
    docs = edge_docs(spark).drop("ids")
    out = stage(spark, docs, SF)
    got = out.collect()
    if name != "bpe_encoding":
        assert out.columns == docs.columns
    assert name not in ("secret_scans", "bpe_encoding") or len(got) == docs.count()
    assert stage(spark, empty_docs(spark), SF).count() == 0
    assert SCHEMA
