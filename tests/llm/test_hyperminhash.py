"""Near-duplicate groups against brute force over all pairs."""

from __future__ import annotations

import re

import numpy as np
import pytest

from basketry.llm import flat, queries
from basketry.llm import hyperminhash as H

from .util import SCHEMA, SF, documents, edge_docs, edge_rows, empty_docs, row, words

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall((text or "").encode().lower())
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, percent):
    """{doc_id: smallest reachable id} over rows (doc_id, text)."""
    rows = [(i, shingles(t, k)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                u, v = top(i), top(j)
                parent[max(u, v)] = min(u, v)
    return {i: top(i) for i in parent}


def check(spark, docs, rows, k, percent):
    got = H.near_duplicates(docs, k, percent).collect()
    want = brute(rows, k, percent)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.doc_id, r.component_id) == (r.doc_id, want[r.doc_id])
            assert r.kept == (r.component_id == r.doc_id)
    return got


def test_query_against_brute_force(spark):
    docs = documents(spark)
    got = {r.doc_id: r for r in queries.op1_hyperminhash(spark, SF).collect()}
    want = brute(docs.items(), 3, 85)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[i].n_shingles == len(shingles(t, 3)) for i, t in docs.items())


def test_edge_rows(spark):
    rows = [(r[0], r[1]) for r in edge_rows()]
    got = check(spark, edge_docs(spark), rows, 3, 85)
    sizes = {r.doc_id: r.n_shingles for r in got}
    assert sizes[4] == sizes[5] == sizes[6] == 0 and sizes[7] == sizes[8] == 1


def test_empty_table(spark):
    assert H.near_duplicates(empty_docs(spark)).count() == 0
    assert H.deduplicated(empty_docs(spark)).count() == 0


@pytest.mark.parametrize("percent,k", [(85, 3), (80, 5)])
def test_large_group_of_near_copies(spark, percent, k, monkeypatch):
    """Copies around one base that are linked by chains only; blocks smaller than the group."""
    monkeypatch.setattr(H, "BLOCK", 8)
    base = words(160, 5).split()
    rng = np.random.default_rng(3)
    rows = []
    for i in range(90):
        w = list(base)
        for at in rng.choice(len(w), rng.integers(1, 9), replace=False):
            w[at] = f"x{i}y{at}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame([row(*r) for r in rows], SCHEMA)
    got = check(spark, docs, rows, k, percent)
    assert 1 < len({r.component_id for r in got}) < 90


def test_repeated_id_with_other_texts_is_one_node(spark):
    a, b = words(50, 1), words(50, 2)
    rows = [(1, a), (5, a), (5, b), (7, b)]
    check(spark, spark.createDataFrame([row(*r) for r in rows], SCHEMA), rows, 3, 85)


def test_ids_in_tables_shuffled_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(H, "BROADCAST_IDS", 0)
    rows = [(r[0], r[1]) for r in edge_rows()]
    check(spark, edge_docs(spark), rows, 3, 85)


def test_estimate_is_near_the_similarity():
    rng = np.random.default_rng(1)
    for common, own in ((900, 50), (300, 300), (40, 5)):
        x = flat.mix(rng.integers(0, 2**63, common + 2 * own).astype(np.uint64))
        a, b = np.sort(x[: common + own]), np.sort(np.r_[x[:common], x[common + own :]])
        true = common / (common + 2 * own)
        n, m = np.array([len(a)]), np.array([len(b)])
        e = H.estimate(H.registers(a)[None], H.registers(b)[None], n, m)[0]
        assert abs(e - true) < 5 * (true * (1 - true) / H.BUCKETS) ** 0.5 + 0.01


def test_chance_matches_simulation():
    rng = np.random.default_rng(2)
    hits = []
    for _ in range(60):
        a, b = (np.sort(flat.mix(rng.integers(0, 2**63, 4000).astype(np.uint64))) for _ in range(2))
        hits.append((H.registers(a) == H.registers(b)).mean())
    assert abs(np.mean(hits) - H.chance(np.array([4000]), np.array([4000]))[0]) < 5e-4


def test_bands_lose_no_pair_at_the_threshold():
    for t in (0.8, 0.85, 0.95):
        r = H.band_rows(t)
        assert (1 - t**r) ** (H.BUCKETS // r) < 1e-6


def test_deduplicated_keeps_columns_and_one_row_each(spark):
    docs = edge_docs(spark)
    out = H.deduplicated(docs, 5, 80)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(None) == 2 and len([i for i in ids if i]) == len({i for i in ids if i})
    assert {1, 4, 5, 6, 7, 8, 10} <= set(ids) and not {2, 3, 9, 11} & set(ids)


def test_word_hashes_lower_ascii_only():
    import pyarrow as pa

    from basketry.llm.common import utf8

    same, other = ["AB\tcd", "ab cd"], ["É x", "é x"]
    for a, b, equal in ((*same, True), (*other, False)):
        s = flat.shingle_sets(*utf8(pa.array([a, b])), 3)
        assert (s[0] == s[1]).all() == equal
