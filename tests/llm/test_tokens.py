"""Token cache and BPE against the tokenizers library."""

from __future__ import annotations

import time

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from basketry.llm import bpe, queries
from basketry.llm import token_cache as C

from .util import SCHEMA, SF, documents, edge_docs, edge_rows, empty_docs, row, sha

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["", " ", "\n\n \t x", "don't we'll I'M", "<|endoftext|>", "a <|endoftext|><|endoftext|> b", "\x1c\x1f\x85\xa0 x", "  y", "1234 五 ٣", "🙂🙂 é", "a" * 3000, "ab" * 1500, "  lead", "trail  ", "x﻿y", "\x00\x01"]


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def check_encoder(texts, **kw):
    enc = bpe.Encoder(bpe.vocabulary(PATH), **kw)
    flat, counts = enc.encode(texts)
    at = np.r_[0, np.cumsum(counts)]
    for k, t in enumerate(texts):
        assert flat[at[k] : at[k + 1]].tolist() == ids(t), t
    back = enc.vocab.decode(flat.astype(np.int64), counts)
    assert back == [LIBRARY.decode(ids(t), skip_special_tokens=False) for t in texts]


def test_encoder_on_odd_texts():
    check_encoder(ODD)


def test_store_starts_anew():
    enc = bpe.Encoder(bpe.vocabulary(PATH), store_words=3)
    for t in ODD * 2:
        assert enc.encode([t])[0].tolist() == ids(t)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs", "Cn", "Co"], max_codepoint=0x2FFF), max_size=60), min_size=1, max_size=4))
def test_encoder_on_any_text(texts):
    check_encoder(texts)


def long_words():
    r = np.random.default_rng(8)
    letters = lambda n, of: "".join(r.choice(list(of), n))
    return [
        letters(30_000, "etaoinshrdlu"),
        letters(9_000, "ab"),
        letters(6_000, "中文字é🙂"),
        "a" * 5000 + "b" + "a" * 4097,
        "-" * 12_345 + "=" * 4_096,
        ("internationalization" * 500)[:9_999],
        "7" * 4_095 + " " + "x" * 4_096 + " y",
        "\n" * 5_000 + "end",
    ]


def test_words_without_spaces():
    check_encoder([*long_words(), "short words between", *long_words()[:2], ""])


@given(st.lists(st.text(alphabet="abcde 1é", min_size=0, max_size=60), max_size=4))
@settings(max_examples=60, deadline=None)
def test_merging_by_places_equals_merging_by_passes(texts):
    v = bpe.vocabulary(PATH)
    for w in texts:
        word = w.encode() or b"x"
        assert v.encode_long(word).tolist() == v.encode_words([word])[0].tolist()


def test_a_text_of_one_word_takes_time_in_proportion():
    """A megabyte without a space: by passes over all symbols this took 59 seconds."""
    r = np.random.default_rng(9)
    text = "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 1_000_000))
    enc = bpe.Encoder(bpe.vocabulary(PATH))
    begin = time.process_time()
    flat, _ = enc.encode([text])
    assert time.process_time() - begin < 15
    assert flat.tolist() == ids(text)


def test_decode_of_any_ids_as_the_library():
    v = bpe.vocabulary(PATH)
    rng = np.random.default_rng(0)
    for _ in range(200):
        x = rng.integers(0, 50257, 9)
        assert v.decode(x, np.array([9]))[0] == LIBRARY.decode(x.tolist(), skip_special_tokens=False)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def test_bpe_query(spark):
    docs = documents(spark)
    got = {r.doc_id: r for r in queries.op9_bpe(spark, SF).collect()}
    for i, t in docs.items():
        x = ids(t)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(x), sha(",".join(map(str, x))))
        assert got[i].decoded_sha256 == sha(LIBRARY.decode(x, skip_special_tokens=False))


def test_bpe_edge_rows(spark):
    docs = edge_docs(spark)
    out = bpe.encode(docs, PATH)
    assert out.columns == [c for c in docs.columns if c != "ids"] + ["ids"]
    got = sorted(((r.doc_id, r.text, list(r.ids)) for r in out.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    want = sorted(((r[0], r[1], ids(r[1] or "")) for r in edge_rows()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    assert got == want
    back = bpe.decode(out, PATH).collect()
    assert all(r.decoded == (r.text or "") for r in back)
    assert bpe.encode(empty_docs(spark), PATH).count() == 0
    null = spark.createDataFrame([(1, None), (2, [50256, 999999, -1])], "doc_id long, ids array<int>")
    assert [r.decoded for r in bpe.decode(null, PATH).orderBy("doc_id").collect()] == ["", "<|endoftext|>"]


def test_token_cache_query(spark):
    docs = documents(spark)
    got = {r.doc_id: r for r in queries.op2_token_cache(spark, SF).collect()}
    for i, t in docs.items():
        n = len(ids(t))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(t.encode()), n, n > 512)


def counted(rows):
    return sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in rows), key=lambda r: (r[0] is None, *[x or 0 for x in r]))


def test_token_cache_edge_rows(spark):
    want = sorted(((r[0], len((r[1] or "").encode()), len(ids(r[1] or ""))) for r in edge_rows()), key=lambda r: (r[0] is None, *[x or 0 for x in r]))
    assert counted(C.token_counts(edge_docs(spark), PATH).collect()) == want
    assert C.token_counts(empty_docs(spark), PATH).count() == 0


def test_only_misses_are_encoded_and_appended(spark, tmp_path):
    cache = str(tmp_path / "cache")
    C.token_counts(spark.createDataFrame([row(1, "one two"), row(2, "one two"), row(3, "x")], SCHEMA), PATH, cache).collect()
    stored = spark.read.parquet(cache)
    assert stored.count() == 2
    # a stored count is taken as it is: the text is not encoded again
    wrong = stored.withColumn("n_tokens", stored.n_tokens + 100).collect()
    other = str(tmp_path / "other")
    spark.createDataFrame(wrong, C.SCHEMA).write.parquet(other)
    got = C.token_counts(spark.createDataFrame([row(7, "one two"), row(8, "new text")], SCHEMA), PATH, other)
    assert counted(got.collect()) == [(7, 7, 102), (8, 8, len(ids("new text")))]
    assert spark.read.parquet(other).count() == 3
    # another tokenizer's counts are its own
    C.token_counts(spark.createDataFrame([row(1, "One  two")], SCHEMA), public_tokenizers.path("word_bpe_49k.json"), other).collect()
    assert spark.read.parquet(other).select("tokenizer_digest").distinct().count() == 2


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(spark, name):
    path = public_tokenizers.path(name)
    got = counted(C.token_counts(edge_docs(spark), path).collect())
    want = [(r[0], len((r[1] or "").encode()), C.count_tokens(path, [r[1] or ""])[0]) for r in edge_rows()]
    assert got == sorted(want, key=lambda r: (r[0] is None, *[x or 0 for x in r]))


def test_normalised_contents_share_a_count(spark, tmp_path):
    cache = str(tmp_path / "cache")
    C.token_counts(spark.createDataFrame([row(1, "Some Text"), row(2, "some text")], SCHEMA), public_tokenizers.path("word_bpe_49k.json"), cache).collect()
    assert spark.read.parquet(cache).count() == 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), min_size=1, max_size=4))
def test_word_counts_equal_the_library(texts):
    assert C.count_tokens(PATH, texts) == [len(ids(t)) for t in texts]


def test_word_counts_on_odd_texts():
    assert C.count_tokens(PATH, ODD) == [len(ids(t)) for t in ODD]
    counts = C.WordCounts(PATH, {"added_tokens": []}, store_words=2)
    plain = [t for t in ODD if "<|" not in t]
    assert [counts.count([t])[0] for t in plain * 2] == [len(ids(t)) for t in plain * 2]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", None])
def test_a_content_is_encoded_once(spark, tmp_path, name):
    """Rows that repeat id and text, null ids and equal texts of other ids: one cache row a content, and none the next time."""
    path = queries.tokenizer(name) if name else next(p for p in _with_normalizer())
    rows = [row(i % 4, f"text number {i % 2}") for i in range(12)] + [row(None, f"text number {i % 3}") for i in range(9)]
    docs = spark.createDataFrame(rows, SCHEMA)
    cache = str(tmp_path / "cache")
    for _ in range(2):
        got = C.token_counts(docs, path, cache).collect()
        assert len(got) == len(rows)
        kept = spark.read.parquet(cache)
        assert kept.count() == kept.select("content_digest").distinct().count() == 3


def _with_normalizer():
    import glob

    return [p for p in sorted(glob.glob("/opt/tokenizers/*.json") + glob.glob("/opt/tokenizers/*.model")) if C.has_normalizer(p)]
