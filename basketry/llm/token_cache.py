"""Token counts through a digest cache.

A cache row maps (content digest, tokenizer version) to a token count.  The
content is normalised as the tokenizer itself does before it splits a text
(a file without a normalizer: as it stands, so equal counts are certain); the
version is the digest of the tokenizer file.  Documents are digested without
moving their texts, joined to the cache by digest, and only one document of
each missing digest is encoded; the new counts are appended to the cache and
every document takes its count from there.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.sources.versions import hadoop

from . import bpe
from .common import fewer_files, gathered, scratch_path, strings, text_slices, texts, written

SCHEMA = "content_digest string, tokenizer_digest string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Version of a tokenizer: digest of its file's bytes."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


@functools.cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def has_normalizer(path: str) -> bool:
    return path.endswith(".model") or _tokenizer(path).normalizer is not None


def normalise(path: str, values: list[str]) -> list[str]:
    t = _tokenizer(path)
    if path.endswith(".model"):
        return [t.normalize(x) for x in values]
    return [t.normalizer.normalize_str(x) for x in values] if t.normalizer else values


def count_tokens(path: str, values: list[str]) -> list[int]:
    """Tokens of each text, as the library counts them."""
    t = _tokenizer(path)
    if path.endswith(".model"):
        return [len(x) for x in t.encode(values, add_bos=False, add_eos=False, num_threads=1)]
    words = _word_counts(path)
    if words is None:
        return [len(x) for x in t.encode_batch_fast(values, add_special_tokens=False)]
    return words.count(values)


@functools.cache
def _word_counts(path: str) -> WordCounts | None:
    """For plain byte-level BPE, where words are encoded one by one; None for other tokenizers."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return WordCounts(path, spec) if bpe.is_plain(spec) else None


class WordCounts:
    """Library counts of distinct words, added up over texts.

    A text is the sequence of its words, and no token crosses a word's end, so
    the library sees each distinct word once.  Texts with special strings or
    letters beyond U+2FFF (whose classes depend on the Unicode version) go to
    the library whole.
    """

    def __init__(self, path: str, spec: dict, store_words: int = bpe.STORE_WORDS):
        self.path, self.store_words = path, store_words
        self.words = regex.compile(bpe.PATTERN)
        special = [regex.escape(t["content"]) for t in spec["added_tokens"]]
        self.whole = regex.compile("|".join([r"[^\x00-\u2fff]", *special]))
        self.stored: dict[str, int] = {}

    def _library(self, values: list[str]) -> list[int]:
        return [len(x) for x in _tokenizer(self.path).encode_batch_fast(values, add_special_tokens=False)]

    def count(self, values: list[str]) -> list[int]:
        if len(self.stored) > self.store_words:
            self.stored = {}
        out = [0] * len(values)
        whole = [i for i, v in enumerate(values) if self.whole.search(v)]
        for i, n in zip(whole, self._library([values[i] for i in whole])):
            out[i] = n
        rest = set(range(len(values))).difference(whole)
        cut = {i: self.words.findall(values[i]) for i in rest}
        new = list({w for words in cut.values() for w in words} - self.stored.keys())
        self.stored.update(zip(new, self._library(new)))
        get = self.stored.__getitem__
        for i, words in cut.items():
            out[i] = sum(map(get, words))
        return out


def _digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes of the text as it stands, digest of the normalised text)."""
    n_bytes = F.octet_length("text").cast("long").alias("n_bytes")
    if not has_normalizer(path):
        return docs.select("doc_id", n_bytes, F.sha2(F.col("text").cast("binary"), 256).alias("content_digest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_slices(whole):
                values = strings(b.column(1))
                digests = [hashlib.sha256(x.encode()).hexdigest() for x in normalise(path, values)]
                sizes = pa.array([len(x.encode()) for x in values], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), sizes, pa.array(digests)], ["doc_id", "n_bytes", "content_digest"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, content_digest string")


def encode_misses(docs: DataFrame, path: str) -> DataFrame:
    """(content_digest, tokenizer_digest, n_tokens) of the given rows; those of one digest that a task meets again are left out."""
    version = tokenizer_digest(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for b in text_slices(whole):
                keys = [int(d[:32], 16) for d in b.column(1).to_pylist()]
                new = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
                if not new:
                    continue
                b = b.take(pa.array(new))
                counts = count_tokens(path, strings(b.column(0)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(1), pa.array([version] * len(counts)), pa.array(counts, pa.int64())],
                    ["content_digest", "tokenizer_digest", "n_tokens"],
                )

    return docs.select("text", "content_digest").mapInArrow(run, SCHEMA)


def token_counts(docs: DataFrame, path: str, cache: str | None = None, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row's whole text.

    ``cache`` is a folder of Parquet files that only grows (a new folder in the
    shared checkpoint folder if none is given); counts for other tokenizers or
    contents in it are left alone.  Null text: empty, 0 bytes, 0 tokens.
    Repeated rows and equal texts are encoded once and all get their row; a
    null doc_id is kept; an empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    cache = cache or scratch_path(spark, "token-cache")
    fs, folder = hadoop(spark, cache)
    if not fs.exists(folder):
        spark.createDataFrame([], SCHEMA).write.mode("append").parquet(cache)
    version = tokenizer_digest(path)
    docs = texts(docs)

    def stored() -> DataFrame:
        own = spark.read.schema(SCHEMA).parquet(cache).where(F.col("tokenizer_digest") == version)
        # runs that append at the same time may store a digest twice, with the same count
        return own.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))

    digests = _digests(docs, path)
    distinct = digests.groupBy("content_digest").agg(F.min("doc_id").alias("doc_id"))
    missing = distinct.join(stored(), "content_digest", "left_anti")
    # the texts of the missing digests: the row with that digest and its smallest doc_id (null ids: any of them)
    rows = docs.join(missing.where("doc_id is not null"), "doc_id")
    if not has_normalizer(path):
        # a doc_id may repeat with other texts
        rows = rows.where(F.sha2(F.col("text").cast("binary"), 256) == F.col("content_digest"))
        unnamed = docs.where("doc_id is null").withColumn("content_digest", F.sha2(F.col("text").cast("binary"), 256))
        unnamed = unnamed.join(missing.where("doc_id is null").select("content_digest"), "content_digest", "left_semi").dropDuplicates(["content_digest"])
        rows = rows.select("text", "content_digest").unionByName(unnamed.select("text", "content_digest"))
        gathered(encode_misses(rows, path)).write.mode("append").parquet(cache)
    else:
        _append_normalised(docs, missing, path, cache)
    # written first, so that the join can split a content with very many copies
    out = digests.join(written(stored(), "counts"), "content_digest")
    return fewer_files(out).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _append_normalised(docs: DataFrame, missing: DataFrame, path: str, cache: str) -> None:
    """As above for a tokenizer with a normalizer: texts are digested again, and only those of missing digests are encoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_slices(whole):
                digests = [hashlib.sha256(x.encode()).hexdigest() for x in normalise(path, strings(b.column(0)))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests)], ["text", "content_digest"])

    ids = missing.select("doc_id").distinct()
    rows = docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    rows = rows.select("text").mapInArrow(run, "text string, content_digest string").join(missing.select("content_digest"), "content_digest", "left_semi")
    gathered(encode_misses(rows.dropDuplicates(["content_digest"]), path)).write.mode("append").parquet(cache)
