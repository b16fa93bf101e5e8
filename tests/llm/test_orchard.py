"""Vector codes against all distances."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from basketry.llm import orchard as X
from basketry.llm import queries

from .util import SF

SCHEMA = "vec_id long, embedding array<float>, label int, length string, code string, error string, part int"


def floor(x):
    return max(-X.BOUND, min(X.BOUND, math.floor(256 * x)))


def brute(rows: list[tuple]) -> list[tuple]:
    kept = [(i, [floor(x) for x in np.array(v, np.float32).astype(float).tolist()], y, v) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for length in {len(r[1]) for r in kept}:
        own = sorted((r for r in kept if len(r[1]) == length), key=lambda r: (r[0] is None, r[0] or 0, r[3]))
        cuts = [(i * length // 16, (i + 1) * length // 16) for i in range(16)]
        books = [[r[1][a:b] for r in own[:64]] for a, b in cuts]

        def near(part, book):
            return min((sum((x - y) ** 2 for x, y in zip(part, e)), k) for k, e in enumerate(book))

        for _ in range(2):
            for p, (a, b) in enumerate(cuts):
                sums = defaultdict(list)
                for r in own:
                    sums[near(r[1][a:b], books[p])[1]].append(r[1][a:b])
                books[p] = [[sum(c) // len(sums[k]) for c in zip(*sums[k])] if k in sums else e for k, e in enumerate(books[p])]
        digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        for r in own:
            got = [near(r[1][a:b], books[p]) for p, (a, b) in enumerate(cuts)]
            out.append((r[0], "".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got), r[2], digest))
    per = defaultdict(int)
    for r in out:
        per[r[3]] += r[2]
    return sorted(((i, c, e, per[y], d) for i, c, e, y, d in out), key=str)


def got(df):
    return sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "l", "c", "e", 1) for i, v, y in rows], SCHEMA)


def vectors(n, length=16, seed=0, spread=1.0):
    r = np.random.default_rng(seed)
    centres = r.normal(0, spread, (9, length))
    return [(int(i), (centres[i % 9] + r.normal(0, 0.05, length)).astype(np.float32).tolist(), [None, 0, 1, 2][i % 4]) for i in range(n)]


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert got(queries.op13_orchard(spark, SF)) == brute(rows)


@pytest.mark.parametrize(("n", "length"), [(300, 32), (40, 16), (1, 16), (90, 20), (80, 5)])
def test_any_length_and_number(spark, n, length):
    rows = vectors(n, length, n)
    assert got(X.vector_codes(frame(spark, rows))) == brute(rows)


def test_edge_rows(spark, monkeypatch):
    one = [0.5] * 16
    rows = [
        (1, one, 1), (1, one, 1), (2, one, None), (3, None, 1), (4, [None, *one[1:]], 1), (5, [float("nan"), *one[1:]], 1), (6, [float("inf"), *one[1:]], 1),
        (7, [-1e-9] * 16, 2), (8, [1e30] * 16, 2), (9, [-1e30] * 16, None), (None, [0.25] * 16, None), (None, None, None), (10, [], 3), (11, [1.0], 3), (12, [1.0, 2.0] * 8, 3), (1, [0.75] * 16, 1),
    ]
    assert got(X.vector_codes(frame(spark, rows))) == brute(rows)
    monkeypatch.setattr(X, "BROADCAST_LABELS", 0)
    assert got(X.vector_codes(frame(spark, rows))) == brute(rows)


def test_empty_table(spark):
    assert X.vector_codes(frame(spark, [])).count() == 0
    assert X.vector_codes(frame(spark, [(1, None, 1)])).count() == 0


def test_partitions_do_not_matter(spark):
    df = frame(spark, vectors(200, 32, 3))
    assert got(X.vector_codes(df.repartition(7))) == got(X.vector_codes(df.coalesce(1)))


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 64), st.integers(1, 4), st.integers(1, 60))
def test_search_is_exact(seed, k, d, span):
    """The nearest entry, the lower of equals, whatever repeats in the codebook."""
    r = np.random.default_rng(seed)
    book, x = r.integers(-span, span + 1, (k, d)), r.integers(-span, span + 1, (50, d))
    entry, dist, _ = X.orchard(x, book)
    all_ = ((x[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    assert (entry == all_.argmin(axis=1)).all() and (dist == all_.min(axis=1)).all()


def test_search_skips_most_entries():
    """In clustered data the bound of twice the distance ends most searches early."""
    r = np.random.default_rng(0)
    book = r.integers(-1000, 1000, (64, 2))
    x = book[r.integers(0, 64, 2000)] + r.integers(-20, 21, (2000, 2))
    *_, computed = X.orchard(x, book)
    assert computed < 0.5 * 64 * len(x)
