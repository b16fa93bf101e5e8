"""Repeated strings against a table of all windows."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from basketry.llm import queries
from basketry.llm import suffix_dedup as X

from .util import SCHEMA, SF, documents, edge_docs, edge_rows, empty_docs, row, sha, words


def brute(texts: list[str]) -> list[tuple]:
    raw = [(t or "").encode() for t in texts]
    n = Counter(t[i : i + X.LENGTH] for t in raw for i in range(len(t) - X.LENGTH + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - X.LENGTH + 1):
            if n[t[i : i + X.LENGTH]] > 1:
                gone[i : i + X.LENGTH] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, sha(np.frombuffer(t, np.uint8)[~gone].tobytes())))
    return out


def rows_of(df):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.kept))) for r in df.collect()))


def expected(rows):
    return sorted((i is None, i or 0, *b) for (i, _), b in zip(rows, brute([t for _, t in rows])))


def passages(n=60, seed=0):
    """Texts with shared passages of many lengths around 200 bytes, at different places, and periodic runs."""
    r = random.Random(seed)
    common = [words(400, 100 + k) for k in range(6)]
    out = []
    for i in range(n):
        parts = [words(r.randint(0, 60), 1000 * seed + i)]
        for _ in range(r.randint(0, 3)):
            c = r.choice(common)
            a = r.randint(0, 1200)
            parts += [c[a : a + r.choice([150, 195, 199, 200, 201, 230, 500, 900])], words(r.randint(0, 40), r.randint(0, 10**6))]
        if i % 9 == 0:
            parts.append("ab" * r.randint(90, 300))
        if i % 7 == 0:
            parts.append("ñé🙂" * r.randint(5, 60))
        out.append((i, " ".join(parts)))
    return out


def test_query(spark):
    docs = documents(spark)
    got = {r.doc_id: r for r in queries.op10_suffix_dedup(spark, SF).collect()}
    for i, want in zip(docs, brute(list(docs.values()))):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want


@pytest.mark.parametrize("chunk", [X.CHUNK, 5])
def test_passages(spark, chunk):
    """In memory, and with shards that go through the queue on disk."""
    rows = passages()
    df = spark.createDataFrame([row(*r) for r in rows], SCHEMA)
    assert rows_of(X.without_repeats(df, chunk)) == expected(rows)


def test_one_large_shard(spark):
    """A passage in 300 different surroundings: one k-gram, many different segments."""
    passage = words(60, 1)[:230]
    rows = [(i, words(30, i + 10) + passage[: 180 + i % 50] + words(30, i + 5000)) for i in range(300)]
    df = spark.createDataFrame([row(*r) for r in rows], SCHEMA)
    for chunk in (X.CHUNK, 16):
        assert rows_of(X.without_repeats(df, chunk)) == expected(rows)


def test_edge_rows(spark):
    rows = [(r[0], r[1]) for r in edge_rows() if r[0] not in (10, 11)]
    df = edge_docs(spark).where("doc_id is null or doc_id not in (10, 11)")
    assert rows_of(X.without_repeats(df)) == expected(rows)
    assert X.without_repeats(empty_docs(spark)).count() == 0


def test_very_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(X, "PIECE", 700)
    rows = passages(20, seed=3) + [(100, " ".join(t for _, t in passages(12, seed=4)))]
    df = spark.createDataFrame([row(*r) for r in rows], SCHEMA).coalesce(1)
    assert rows_of(X.without_repeats(df)) == expected(rows)


def test_texts_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(X, "BROADCAST_IDS", 0)
    rows = passages(30, seed=5)
    df = spark.createDataFrame([row(*r) for r in rows], SCHEMA)
    assert rows_of(X.without_repeats(df)) == expected(rows)


def test_equal_windows_have_equal_anchors():
    data = np.frombuffer((words(80, 1) + words(200, 2)[:700] + words(50, 3) + words(200, 2)[:700]).encode(), np.uint8)
    gram, digest, start, n, anchor = X.anchors(data, np.ones(len(data), bool))
    assert n.sum() == len(data) - X.LENGTH + 1
    place = {}
    for g, a, m, c in zip(gram, start, n, anchor):
        assert a + m - 1 <= c and c + X.GRAM <= a + X.LENGTH
        for i in range(a, a + m):
            w = data[i : i + X.LENGTH].tobytes()
            assert place.setdefault(w, (g, c - i)) == (g, c - i)


def test_queue_orders_by_byte_then_arrival_and_leaves_no_file(tmp_path):
    dtype = np.dtype([("rank", np.int64)])
    q = X.DiskQueue(f"file://{tmp_path}/q", dtype, 4)
    r = random.Random(1)
    want = {}
    for rank in range(50):
        c = r.randrange(256)
        q.push(c, np.array([(rank,)], dtype))
        want.setdefault(c, []).append(rank)
    got = [int(x) for b in q.pop() for x in b["rank"]]
    assert got == [x for c in sorted(want) for x in want[c]]
    assert not list((tmp_path / "q").iterdir())
    q.close()


def test_induction_on_disk_equals_in_memory(tmp_path):
    r = np.random.default_rng(5)
    n, width = 60, X.LENGTH - X.GRAM
    base = r.integers(97, 100, X.LENGTH + width).astype(np.uint8)
    full = np.tile(base, (n, 1))
    for i in range(n):
        for at in r.integers(0, X.LENGTH + width, r.integers(0, 3)):
            if not width <= at < width + X.GRAM:
                full[i, at] = 120
    lo, hi = r.integers(0, 20, n), r.integers(40, width + 1, n)
    suffix = [full[i, width : width + X.LENGTH - lo[i]].tobytes() for i in range(n)]
    order = sorted(range(n), key=lambda i: suffix[i])
    suffix, lo, hi = [suffix[i] for i in order], lo[order], hi[order]
    before = full[order, :width][:, ::-1].copy()
    lcp = X._prefixes(X._matrix(suffix, X.LENGTH), np.array(list(map(len, suffix))), np.zeros(n))
    want = {(int(i), int(s)) for i, s in zip(*np.nonzero(X.induce(np.zeros(n, int), lcp, before, lo, hi)))}
    dtype = np.dtype([("digest", np.int64), ("lcp", np.int16), ("lo", np.int16), ("hi", np.int16), ("before", np.uint8, (width,))])
    x = np.zeros(n, dtype)
    x["digest"], x["lcp"], x["lo"], x["hi"], x["before"] = np.arange(n), lcp, lo, hi, before
    for size, limit in ((n, 1000), (7, 5), (1, 1)):
        blocks = (x[i : i + size] for i in range(0, n, size))
        got = {(int(d), s) for ds, s in X.induce_on_disk(blocks, f"file://{tmp_path}/{size}", limit) for d in ds}
        assert got == want and want
