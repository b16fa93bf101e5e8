"""Embedding groups against brute force, with planted near copies."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.llm import flat_graph as X
from basketry.llm import queries

SF = "/root/testdata/sf0.01"


def brute(ids, v, threshold=0.9):
    """{id: (links, smallest reachable)} over rows; v: unit vectors or None."""
    ok = [k for k, x in enumerate(v) if x is not None and ids[k] is not None]
    m = np.array([v[k] for k in ok])
    m = m / np.linalg.norm(m, axis=1)[:, None]
    near = m @ m.T >= threshold
    own = np.array([ids[k] for k in ok])
    root = {i: i for i in ids if i is not None}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in zip(*np.nonzero(np.triu(near, 1))):
        p, q = top(own[a]), top(own[b])
        root[max(p, q)] = min(p, q)
    n = dict.fromkeys(root, 0)
    for k, i in enumerate(own):
        n[i] = int(near[k].sum()) - 1
    return {i: (n[i], top(i)) for i in root}


def frame(spark, ids, vectors):
    rows = [(i, None if x is None else [float(y) if y is not None else None for y in x], 1, "x") for i, x in zip(ids, vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id string")


def planted(n, groups, seed=0, d=32, noise=0.3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    at = 0
    for size in groups:
        c = rng.normal(size=d)
        x[at : at + size] = c + noise * rng.normal(size=(size, d)) * rng.uniform(0.2, 1, (size, 1))
        at += size
    x /= np.linalg.norm(x, axis=1)[:, None]
    return list(x[rng.permutation(n)].astype(np.float32).astype(float))


def check(got, want, least=0.98):
    assert len(got) == len(want)
    true = sum(n for n, _ in want.values())
    assert all(r.n_links <= want[r.vec_id][0] for r in got)
    assert sum(r.n_links for r in got) >= least * true
    for r in got:
        assert r.kept == (r.vec_id == r.component_id)
    if sum(r.n_links for r in got) == true:
        assert all(r.component_id == want[r.vec_id][1] for r in got)


def test_query(spark):
    t = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    want = brute([r.vec_id for r in t], [r.embedding for r in t])
    check(queries.op8_flat_graph(spark, SF).collect(), want)


@pytest.mark.parametrize("rows", [X.SHARD_ROWS, 120])
def test_planted_groups(spark, rows):
    """One shard, and shards that are split and cut into blocks (the large group fits in none)."""
    v = planted(1500, (400, 60, 20, 5, 2, 2))
    want = brute(list(range(1500)), v)
    assert max(n for n, _ in want.values()) > 200
    got = X.linked(frame(spark, range(1500), v), shard_rows=rows).collect()
    check(got, want)
    assert got[0].audit_recall >= X.TARGET


def test_copies_and_unusable_vectors(spark):
    v = planted(40, (6, 3), seed=3, d=8)
    v += [v[0]] * 30 + [v[1]] * 2 + [None, [0.0] * 8, [float("nan"), *[1.0] * 7], [float("inf"), *[1.0] * 7], [None, *[1.0] * 7], [1.0, 2.0], [], [x * 1e30 for x in v[2]]]
    ids = list(range(len(v)))
    usable = [x if x is not None and len(x) == 8 and all(y is not None and np.isfinite(y) for y in x) and any(x) else None for x in v]
    df = frame(spark, [*ids, None], [*v, v[0]])
    got = X.linked(df).collect()
    assert len(got) == len(ids) + 1
    null = [r for r in got if r.vec_id is None]
    assert len(null) == 1 and null[0].component_id is None and null[0].kept and null[0].n_links == 0
    want = brute(ids, usable)
    for r in got:
        if r.vec_id is not None:
            assert (r.n_links, r.component_id) == want[r.vec_id], r


def test_repeated_ids_and_empty_table(spark):
    v = planted(6, (2,), seed=5, d=8)
    got = X.linked(frame(spark, [0, 1, 1, 2, 3, 4], v)).collect()
    assert sorted(r.vec_id for r in got) == [0, 1, 1, 2, 3, 4]
    assert X.linked(frame(spark, [], [])).count() == 0
    assert [(r.n_links, r.component_id) for r in X.linked(frame(spark, [9], [None])).collect()] == [(0, 9)]


def test_vectors_of_two_lengths(spark):
    """Each length has its links, exact copies of the rarer one included."""
    a, b = planted(60, (10, 4), seed=8, d=8), planted(25, (6, 2), seed=9, d=3, noise=0.1)
    a += [a[0]] * 3
    b += [b[0]] * 3
    got = {r.vec_id: (r.n_links, r.component_id) for r in X.linked(frame(spark, range(len(a) + len(b)), a + b)).collect()}
    want = brute(list(range(len(a))), a) | brute(list(range(len(a), len(a) + len(b))), b)
    assert got == want and max(n for n, _ in got.values()) >= 3


def test_a_repeated_id_names_several_vectors(spark):
    """Rows of one vec_id are vectors of their own: near links of each are found, and their copies."""
    v = planted(30, (5, 4), seed=12, d=8)
    ids = [i if i % 3 else 7 for i in range(30)] + [7, 7, 40]
    v += [v[0], v[3], v[6]]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in X.linked(frame(spark, ids, v)).collect())
    m = np.array(v) / np.linalg.norm(v, axis=1)[:, None]
    near = m @ m.T >= 0.9
    want = []
    for k in range(len(ids)):
        seen, todo = set(), {k}
        while todo:
            seen |= todo
            todo = {int(j) for i in todo for j in np.flatnonzero(near[i])} - seen
        top = min(ids[j] for j in seen)
        want.append((ids[k], int(near[k].sum()) - 1, top, ids[k] == top))
    assert got == sorted(want)


def test_the_last_overlap_ends_exact(spark, monkeypatch):
    """Searches that find nothing: the audit says so at every overlap, and the end compares blocks in full."""
    monkeypatch.setattr(X, "search", lambda v, links, start, q, threshold: np.zeros(0, np.int64))
    monkeypatch.setattr(X, "MAX_CLUSTERS", 8)
    v = planted(300, (40, 10, 3), seed=13)
    got = X.linked(frame(spark, range(300), v), shard_rows=60).collect()
    want = brute(list(range(300)), v)
    assert all((r.n_links, r.component_id) == want[r.vec_id] for r in got) and got[0].audit_recall == 1.0


def test_recall_of_every_class_beside_a_hot_group(spark):
    """A third of all rows are near copies of one another: small groups have their links all the same."""
    v = planted(900, (300, *[3] * 60), seed=14, noise=0.2)
    want = brute(list(range(900)), v)
    got = {r.vec_id: r.n_links for r in X.linked(frame(spark, range(900), v), shard_rows=150).collect()}
    linked = [i for i, (n, _) in want.items() if n]
    assert sum(got[i] / want[i][0] for i in linked) / len(linked) >= 0.98


def test_the_audit_is_not_drowned_by_a_hot_group(spark):
    """All links of the hot group found, none of the others: far below the target."""
    v = planted(600, (300, *[2] * 60), seed=15, noise=0.1)
    want = brute(list(range(600)), v)
    own = X.units(frame(spark, range(600), v).select("vec_id", "embedding"))
    rows = own.join(X.classes(own), "key").select("id", "copies", "v")
    found = spark.createDataFrame([(i, n if n > 100 else 0) for i, (n, _) in want.items()], "id long, n long")
    assert X._audit(rows, found, 0.9, 600) < 0.9
    assert X._audit(rows, spark.createDataFrame([(i, n) for i, (n, _) in want.items()], "id long, n long"), 0.9, 600) == 1.0


def test_every_node_is_reached_and_degrees_are_bounded():
    v = np.array(planted(700, (300, 40), seed=2))
    links = X.pruned(v, 1)
    seen, wave = set(), {X.medoid(v)}
    while wave:
        seen |= wave
        wave = {int(b) for a in wave for b in links[a]} - seen
    assert len(seen) == 700
    assert np.mean([len(x) for x in links]) <= X.DEGREE + 1


def test_robust_rule():
    v = np.array(planted(200, (30,), seed=4))
    for a, kept in zip(range(50), X._robust(v, np.arange(50), np.tile(np.arange(200), (50, 1)), 16, 1.2)):
        to = 1 - v @ v[a]
        assert a not in kept and len(set(kept)) == len(kept) <= 16
        for i, b in enumerate(kept):
            assert all(1.44 * (1 - v[c] @ v[b]) > to[b] - 1e-12 for c in kept[:i])


def test_a_low_recall_raises_the_overlap(spark, monkeypatch):
    """With a search that misses shards the audit notices and deals classes to more of them."""
    seen = []
    real = X._links

    def counted(rows, threshold, overlap, shard_rows, exact=False):
        seen.append(overlap)
        return real(rows, threshold, overlap, shard_rows, exact)

    monkeypatch.setattr(X, "_links", counted)
    v = planted(900, (2,) * 200, seed=7, noise=0.42)
    got = X.linked(frame(spark, range(900), v), overlap=1, shard_rows=90).collect()
    check(got, brute(list(range(900)), v), least=0.95)
    assert seen[0] == 1 and len(seen) > 1


def test_no_search_holds_a_whole_ball(spark, monkeypatch):
    """A ball of distinct near copies in one shard of ten blocks: queries are cut into blocks like members."""
    sizes = []
    real = X._found

    def seen(rows, threshold, exact=False):
        keys = [c for c in ("shard", "block", "part") if c in rows.columns]
        sizes.extend(r["count"] for r in rows.groupBy(*keys).count().collect())
        return real(rows, threshold, exact)

    monkeypatch.setattr(X, "_found", seen)
    monkeypatch.setattr(X, "shards", lambda rows, overlap, shard_rows: rows.withColumn("shard", F.lit("0")).withColumn("g", F.lit(10)))
    v = planted(600, (560, 20), seed=11, noise=0.05)
    own = X.units(frame(spark, range(600), v).select("vec_id", "embedding"))
    heads = own.join(X.classes(own), "key").select("id", "copies", "v")
    got = X._links(heads, 0.9, 4, 60).collect()
    want = brute(list(range(600)), v)
    n = dict.fromkeys(want, 0)
    for r in got:
        n[r.id] += r.n
        assert want[r.id][1] == want[r.root][1]
    assert all(n[i] <= m for i, (m, _) in want.items())
    assert sum(n.values()) >= 0.98 * sum(m for m, _ in want.values())
    # two blocks, which vary about their mean
    assert max(sizes) <= 3 * 60
