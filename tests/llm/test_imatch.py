"""I-Match fingerprints: successors and edits against a loop, properties of the fingerprints."""

from __future__ import annotations

from collections import Counter

import pytest
import regex
import xxhash

from basketry.llm import imatch as X
from basketry.llm import queries

from .util import SCHEMA, SF, documents, edge_docs, empty_docs, row, sha, words


def edits(docs: dict) -> dict:
    """{doc_id: (edited text, next id)}"""
    ids = sorted(docs)
    out = {}
    for k, i in enumerate(ids):
        nxt = ids[(k + 1) % len(ids)]
        cut = len(docs[i]) // 4
        out[i] = (docs[i][: len(docs[i]) - cut] + docs[nxt][:cut], nxt)
    return out


def check(got, docs):
    want = edits(docs)
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    for i, (text, nxt) in want.items():
        r = by[i]
        assert (r.n_chars, r.edited_sha256) == (len(docs[i]), sha(text))
        a, b, e = (x.split(".") for x in (r.fingerprint, by[nxt].fingerprint, r.edited_fingerprint))
        for other, near in ((b, r.near_next), (e, r.near_edited)):
            seen = [(x, y) for x, y in zip(a, other) if x or y]
            assert near == pytest.approx(sum(x == y for x, y in seen) / max(len(seen), 1))
    return by


def test_query(spark):
    docs = documents(spark)
    by = check(queries.op3_imatch(spark, SF).collect(), docs)
    first = {}
    for i, t in docs.items():
        assert first.setdefault(t, by[i].fingerprint) == by[i].fingerprint
    assert sum(r.near_edited for r in by.values()) > 10 * sum(r.near_next for r in by.values())


def test_fine_grid_of_buckets(spark, monkeypatch):
    """Several documents to a bucket of the finest kind, ids with gaps."""
    monkeypatch.setattr(X, "GRID", 2)
    monkeypatch.setattr(X, "BUCKET_ROWS", 3)
    rows = [row(i * i * 17 % 100_003, words(30 + i, i)) for i in range(1, 90)]
    docs = {r[0]: r[1] for r in rows}
    assert len(docs) == 89
    check(X.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect(), docs)


def test_tables_beyond_the_broadcast_bounds(spark, monkeypatch):
    monkeypatch.setattr(X, "BROADCAST_TERMS", 0)
    monkeypatch.setattr(X, "BROADCAST_FINER", 0)
    check(X.fingerprints(spark.read.parquet(f"{SF}/documents.parquet")).collect(), documents(spark))


def test_native_plan(spark):
    plan = X.fingerprints(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_edge_rows(spark):
    got = X.fingerprints(edge_docs(spark)).collect()
    assert len(got) == 17 and X.fingerprints(empty_docs(spark)).count() == 0
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].fingerprint == by[2][0].fingerprint and by[1][0].near_next == 1.0
    assert by[4][0].n_chars == 0 and by[4][0].edited_sha256 == sha("")
    assert by[4][0].fingerprint == by[5][0].fingerprint and by[4][0].near_next == 1.0
    assert {r.near_next for r in by[None]} == {0.0}
    text = words(50, 3)
    assert {r.edited_sha256 for r in by[None]} == {sha(""), sha(text[: len(text) - len(text) // 4])}
    # repeated rows: the second row of an id is the first one's next document
    assert len(by[9]) == 2 and by[9][0].fingerprint == by[9][1].fingerprint and 1.0 in {r.near_next for r in by[9]}
    last = by[14][0]
    assert last.edited_sha256 == sha("a" * 3750 + words(120, 1)[:1250])


def test_one_document_is_its_own_next(spark):
    r = X.fingerprints(spark.createDataFrame([row(5, "abcdefgh")], SCHEMA)).collect()
    assert len(r) == 1 and r[0].edited_sha256 == sha("abcdefab") and r[0].near_next == 1.0


def test_lexicon_band_counts_every_document(spark):
    rows = [row(i, f"common {'half' if i % 2 else 'other'} pair{i // 2} own{i}") for i in range(40)]
    words_ = X.lexicon(spark.createDataFrame(rows, SCHEMA).select("text"), 0.001, 0.1).count()
    assert words_ == 20  # the pairs: two documents each


def test_terms(spark):
    df = spark.createDataFrame([("Ab ab, Ça-va 12",), ("",), ("!!",)], "text string")
    assert [sorted(r.t) for r in df.select(X.terms(df.text).alias("t")).collect()] == [["12", "ab", "va", "ça"], [], []]


def test_texts_without_a_term_in_any_subset_have_a_part(spark):
    """Lexicon terms alone give no part: equal texts are alike, unrelated ones are not."""
    pairs = [f"pair{k} only{k}" for k in range(60)]
    rows = [row(2 * k + j, t) for k, t in enumerate(pairs) for j in (0, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    blank = X.lexicon(docs.select("text")).where("subsets = 0").count()
    assert blank > 20
    got = {r.doc_id: r for r in X.fingerprints(docs).collect()}
    assert all(set(r.fingerprint) != {"."} and set(r.edited_fingerprint) != {"."} for r in got.values())
    for k in range(60):
        assert got[2 * k].fingerprint == got[2 * k + 1].fingerprint and got[2 * k].near_next == 1.0
    whole = [got[2 * k].fingerprint for k in range(60) if got[2 * k].fingerprint.startswith("text:")]
    assert len(whole) >= 5 and len(set(whole)) == len(whole)


class Plain:
    """Fingerprints by a loop: terms, document frequencies, band, subsets and hashes without Spark."""

    def __init__(self, texts: list[str]):
        held = Counter(t for text in texts for t in self.terms(text))
        n = len(texts)
        band = {t for t, c in held.items() if max(2, X.MIN_SHARE * n) <= c <= max(2, X.MAX_SHARE * n)}
        self.subsets = {}
        for t in band:
            h = self.string(t)
            self.subsets[t] = (h, [j for j, r in enumerate(X.RATES) if self.number(j, 4, self.number(h, 8, 42)) % (1 << r) == 0])

    @staticmethod
    def terms(text: str) -> set[str]:
        return set(regex.split(r"[^\p{L}\p{N}]+", text.lower())) - {""}

    @staticmethod
    def signed(h: int) -> int:
        return h - (1 << 64) if h >> 63 else h

    def string(self, s: str) -> int:
        return self.signed(xxhash.xxh64(s.encode(), 42).intdigest())

    def number(self, x: int, size: int, seed: int) -> int:
        return self.signed(xxhash.xxh64(x.to_bytes(size, "little", signed=True), seed % (1 << 64)).intdigest())

    def fingerprint(self, text: str) -> str:
        found = sorted(self.subsets[t] for t in self.terms(text) if t in self.subsets)
        parts = []
        for j in range(len(X.RATES)):
            h, any_ = 42, False
            for term, bits in found:
                if j in bits:
                    any_ = True
                    h = self.number(sum(1 << k for k in bits), 8, self.number(term, 8, h))
            parts.append(f"{h % (1 << 64):X}" if any_ else "")
        return ".".join(parts) if any(parts) else ".".join([f"text:{self.string(text) % (1 << 64):X}", *[""] * (len(parts) - 1)])


def test_fingerprints_against_a_loop(spark):
    """Every fingerprint of the query, of documents and of their edited texts, from the texts alone."""
    docs = documents(spark)
    plain, want = Plain(list(docs.values())), edits(docs)
    got = queries.op3_imatch(spark, SF).collect()
    assert len(got) == len(docs) and len(plain.subsets) > 100
    for r in got:
        assert r.fingerprint == plain.fingerprint(docs[r.doc_id])
        assert r.edited_fingerprint == plain.fingerprint(want[r.doc_id][0])
