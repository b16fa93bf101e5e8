"""Connected components against a plain union of edges."""

from __future__ import annotations

import random

import pytest

from basketry.llm import components as C
from basketry.llm.components import connected_components


def brute(edges):
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        u, v = top(a), top(b)
        parent[max(u, v)] = min(u, v)
    return {x: top(x) for x in parent}


def test_random_chain_star_and_loops(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(60)]
    edges += [(2000, 2001 + i) for i in range(80)] + [(2500, 2500), (5, 5), (1000, 1001)]
    df = spark.createDataFrame([*edges, (None, 1), (2, None)], "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    want = brute([e for e in edges if e[0] != e[1]])
    assert got == want


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("most", [4, 50_000])
def test_hot_nodes_take_the_broadcast_way(spark, monkeypatch, most):
    """Hubs above and below all their neighbours, and one in the middle of theirs, linked to each other."""
    monkeypatch.setattr(C, "HOT", 20)
    monkeypatch.setattr(C, "MOST", most)
    asked = []
    real = C.F.broadcast
    monkeypatch.setattr(C.F, "broadcast", lambda df: asked.append(1) or real(df))
    edges = [(0, 10 + i) for i in range(60)] + [(900, 300 + i) for i in range(60)] + [(500, 400 + 3 * i) for i in range(60)]
    edges += [(12, 300), (2000, 2001), (2001, 2002)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == brute(edges)
    assert asked
