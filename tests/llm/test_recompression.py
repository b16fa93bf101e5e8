"""Repeated word windows against a table of all windows."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from basketry.llm import flat, queries
from basketry.llm import recompression as X

from .util import SCHEMA, SF, documents, edge_docs, edge_rows, empty_docs, row, sha, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts: list[str], length: int = X.LENGTH) -> list[tuple]:
    split = [WORD.findall(t or "") for t in texts]
    n = Counter(tuple(w[i : i + length]) for w in split for i in range(len(w) - length + 1))
    out = []
    for w in split:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - length + 1):
            if n[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(w), int(gone.sum()), spans, " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def rows_of(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.n_spans, r.kept) for r in df.collect())


def expected(rows):
    return sorted((i is None, i or 0, *b) for (i, _), b in zip(rows, brute([t for _, t in rows])))


def passages(n=60, seed=0):
    """Texts with shared passages around 35 words, at different places, runs and periods, odd white space."""
    r = random.Random(seed)
    common = [words(120, 100 + k).split() for k in range(5)]
    out = []
    for i in range(n):
        parts = words(r.randint(0, 40), 1000 * seed + i).split()
        for _ in range(r.randint(0, 3)):
            c = r.choice(common)
            a = r.randint(0, 60)
            parts += c[a : a + r.choice([20, 33, 34, 35, 36, 40, 60])] + words(r.randint(0, 20), r.randint(0, 10**6)).split()
        if i % 9 == 0:
            parts += ["la"] * r.randint(20, 90)
        if i % 7 == 0:
            parts += ["é", "ñ", "🙂"] * r.randint(5, 40)
        if i % 11 == 0:
            parts += ["x", "y", "x", "y", "z"] * r.randint(5, 20)
        out.append((i, r.choice([" ", "\t", "\x0b\n ", " \r"]).join(parts)))
    return out


def test_query(spark):
    docs = documents(spark)
    got = {r.doc_id: r for r in queries.op11_recompression(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for (i, _), (n, removed, _, kept) in zip(docs.items(), brute(list(docs.values()))):
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (n, removed, sha(kept))


def test_edge_rows(spark):
    assert rows_of(X.without_repeats(edge_docs(spark))) == expected([(r[0], r[1]) for r in edge_rows()])


def test_empty_table(spark):
    assert X.without_repeats(empty_docs(spark)).count() == 0


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_passages(spark, seed):
    rows = passages(60, seed)
    assert rows_of(X.without_repeats(spark.createDataFrame([row(i, t) for i, t in rows], SCHEMA))) == expected(rows)


def test_short_pieces_and_shuffled_texts(spark, monkeypatch):
    """Pieces of 50 words cut segments anywhere; without broadcasts texts are joined by a shuffle."""
    monkeypatch.setattr(X, "PIECE", 50)
    monkeypatch.setattr(X, "BROADCAST_IDS", 0)
    rows = passages(40, 5)
    docs = spark.createDataFrame([row(i, t) for i, t in rows], SCHEMA)
    assert rows_of(X.without_repeats(docs)) == expected(rows)


def test_one_hot_passage(spark):
    """A third of all documents share one passage, each in its own surroundings; as many are copies of one text."""
    hot, copy = words(50, 1), words(80, 2)
    rows = []
    for i in range(300):
        own = [words(30, 50 + i), words(25, 5000 + i)]
        rows.append((i, copy if i % 3 == 0 else f" {hot} ".join(own) if i % 3 == 1 else words(60, 9000 + i)))
    assert rows_of(X.without_repeats(spark.createDataFrame([row(i, t) for i, t in rows], SCHEMA))) == expected(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=120), st.lists(st.integers(0, 4), max_size=40), st.integers(1, 12))
def test_names_depend_on_the_window_alone(text, around, length):
    """Equal windows have equal names and anchors wherever they stand; different ones differ."""
    w = np.array([*around, *text, *around, *text])
    anchor, at, name = X.windows(flat.mix(w.astype(np.uint64) + np.uint64(7)), length)
    by_window, by_name = {}, {}
    for i in range(len(name)):
        window, key = tuple(w[i : i + length]), (int(anchor[i]), int(name[i]), int(at[i]) - i)
        assert 0 <= key[2] < length
        assert by_window.setdefault(window, key) == key and by_name.setdefault(key[:2], window) == window


def test_rounds_shorten_runs_and_pairs():
    s = flat.mix(np.array([1, 1, 1, 2, 3, 3, 4], np.uint64))
    out, to, first, size = X._runs(s)
    assert to.tolist() == [0, 0, 0, 1, 2, 2, 3] and first.tolist() == [0, 3, 4, 6] and size.tolist() == [3, 1, 2, 1]
    assert out[1] == s[3] and out[0] != s[0]
    long = flat.mix(np.arange(10_000, dtype=np.uint64))
    pairs, to, first, _ = X._pairs(long, 0)
    assert 0.7 < len(pairs) / len(long) < 0.8 and to[-1] == len(pairs) - 1 and (np.diff(first) <= 2).all()
