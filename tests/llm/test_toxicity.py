"""Toxicity: matching against brute force, held-out accuracy, leakage, defined results."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.llm import queries
from basketry.llm import toxicity as X

from .util import SCHEMA, edge_docs, edge_rows, empty_docs, row, words

SF01 = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    got = queries.op7_toxicity(spark, SF01).collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    p, y = map(np.array, zip(*[(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]))
    # some toxic documents are junk whose words were replaced
    assert (p == y).mean() > 0.97 and p[y == 1].mean() > 0.8 and p[y == 0].mean() < 0.005


def test_held_out_labels_change_nothing(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").limit(1500)
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    a, b = (X.train(docs, x) for x in (labels, flipped))
    assert a == b and a.terms


def test_folding():
    assert X.folded("ІDI0T") == "idiot"  # Ukrainian I, zero
    assert X.folded("st​up1d") == "stupid"
    assert X.folded("ｍｏｒｏｎ") == "moron"
    assert X.folded("Été") == "été"


def test_matches_against_brute_force():
    r = random.Random(2)
    lex = X.Lexicon({"bad": 2.0, "ab": 1.0, "rotten egg": 3.0}, {"ba": 0.5, "cab": 1.5}, ("bad luck", "ab cab"))
    m = X.Matcher(lex)
    alphabet = ["bad", "luck", "ab", "cab", "cabs", "ba", "xbad", "rotten", "egg", ",", "bada"]
    for _ in range(200):
        t = " ".join(r.choices(alphabet, k=12))
        want, shut = {}, []

        def ends(e, t=t):
            return e == len(t) or not (t[e].isalnum() or t[e] == "_")

        for a in range(len(t)):
            if a and (t[a - 1].isalnum() or t[a - 1] == "_"):
                continue
            for s, w in lex.terms.items():
                if t.startswith(s, a) and ends(a + len(s)) and w > want.get(a, (0, 0))[1]:
                    want[a] = (a + len(s), w)
            for s, w in lex.stems.items():
                if t.startswith(s, a) and w > want.get(a, (0, 0))[1]:
                    want[a] = (a + len(s), w)
            for s in lex.exceptions:
                if t.startswith(s, a) and ends(a + len(s)):
                    shut.append((a, a + len(s)))
        want = [(a, b, w) for a, (b, w) in sorted(want.items()) if not any(x <= a and b <= y for x, y in shut)]
        assert m.found(t) == want


def test_score_rises_with_evidence_and_falls_with_length():
    m = X.Matcher(X.Lexicon({"bad": 5.0, "evil": 5.0}))
    assert m.score("bad evil") > m.score("bad x") > m.score("bad " + "x " * 50) > m.score("x")
    assert m.score("") == m.score("x")
    assert X.Matcher(X.Lexicon({})).score("bad") < 0.7


def test_learns_words_stems_and_exceptions(spark):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        t = words(20, i).split()
        if toxic:
            t.insert(r.randrange(20), r.choice(["scoundrel", "zzkq" + "".join(r.choices("abc", k=3))]))
        elif i % 18 == 1:
            t[3:3] = ["lovable", "scoundrel"]
        rows.append(row(i, " ".join(t)))
        labels.append((i, 1, int(toxic)))
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lex = X.train(docs, labels)
    assert any("zzkq".startswith(s) or s.startswith("zzkq") for s in lex.stems)
    assert "lovable scoundrel" in lex.exceptions
    got = {x.doc_id: x for x in X.toxicity(docs, labels).collect()}
    held = [x for x in got.values() if x.held_out]
    assert sum(x.predicted == int(x.doc_id % 3 == 0) for x in held) > 0.97 * len(held)


def test_lexicon_against_a_plain_count(spark):
    """Weights, evidence, the covering rule, exceptions and the curve's inputs, term by term over a small sample."""
    r = random.Random(3)
    rows = []
    for i in range(240):
        t = words(12, 900 + i % 40).split()
        if i % 3 == 0:
            t.insert(r.randrange(12), r.choice(["villain", "villainy", "zzkqa", "zzkqb", "rascal"]))
        elif i % 12 == 1:
            t[2:2] = ["dear", "rascal"]
        rows.append((" ".join(t), int(i % 3 == 0)))
    n1, n0 = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    lex = X.learn(spark.createDataFrame(rows, "text string, toxic int"), n1, n0)

    def g2(a, b):
        cells = [(a, (a + b) * n1), (b, (a + b) * n0), (n1 - a, (n1 + n0 - a - b) * n1), (n0 - b, (n1 + n0 - a - b) * n0)]
        return 2 * sum(x * math.log(x * (n1 + n0) / e) for x, e in cells if x)

    held = [Counter(), Counter()]
    pairs = [Counter(), Counter()]
    for t, y in rows:
        own = set(t.split())
        held[1 - y].update(own | {w[:k] + "*" for w in own for k in (4, 5, 6, 7) if len(w) > k})
        pairs[1 - y].update(set(map(" ".join, zip(t.split(), t.split()[1:]))))
    good = {}
    for t in held[0] | held[1]:
        a, b = held[0][t], held[1][t]
        w = math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
        if w >= math.log(5) and g2(a, b) >= X.MIN_EVIDENCE and a >= X.MIN_SHARE * n1:
            good[t] = w
    terms, stems = {}, {}
    for t in sorted(good, key=lambda t: (not t.endswith("*"), len(t), t)):
        own = t.rstrip("*")
        if good[t] > max((w for s, w in stems.items() if own.startswith(s)), default=0.0) + 0.3:
            (stems if t.endswith("*") else terms)[own] = good[t]
    assert lex.terms == pytest.approx(terms) and lex.stems == pytest.approx(stems) and stems
    matches = lambda p: any(w in terms or any(w.startswith(s) for s in stems) for w in p.split())
    shut = {p for p in pairs[0] | pairs[1] if matches(p) and pairs[1][p] >= 2 and pairs[1][p] / n0 > 5 * pairs[0][p] / n1 and g2(pairs[0][p], pairs[1][p]) >= X.MIN_EVIDENCE / 3}
    assert set(lex.exceptions) == shut
    # the curve is a stationary point of the penalised loss, or stands at the bound of its slopes
    m = X.Matcher(lex)
    x = np.array([[1, math.log1p(w), math.sqrt(w / max(n, 1))] for w, n in (m.evidence(t) for t, _ in rows)])
    y, c = np.array([y for _, y in rows]), np.array([lex.bias, lex.total, lex.density])
    grad = x.T @ (1 / (1 + np.exp(-x @ c)) - y) / len(y) + np.array([0, 1e-3, 1e-3]) * c
    assert all(abs(g) < 1e-3 or (v == 0 and g > 0) for g, v in zip(grad, c))


def test_no_cap_on_the_lexicon(spark):
    """More terms than any fixed number of a smaller lexicon: each that the evidence carries is kept."""
    r = random.Random(9)
    letters = "bcdfghjklmnpqrstvwxz"
    own = r.sample(["".join(w) for w in product(letters, repeat=4)], 6500)  # too short for stems
    rows = [(" ".join(own if i < 40 else []) + " " + words(5, i), int(i < 40)) for i in range(80)]
    lex = X.learn(spark.createDataFrame(rows, "text string, toxic int"), 40, 40)
    assert len(lex.terms) + len(lex.stems) > 5000


def test_edge_rows(spark):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (None, 1, 0), (3, None, None), (1, 1, 1), (77, 1, 0)], "doc_id long, quality int, toxic int")
    got = X.toxicity(edge_docs(spark), labels).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r.score <= 1 for r in got)
    assert X.toxicity(empty_docs(spark), labels).count() == 0
    none = labels.where("false")
    assert all(r.predicted == 0 for r in X.toxicity(edge_docs(spark), none).collect())
