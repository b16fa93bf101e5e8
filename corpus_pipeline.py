"""A corpus pipeline over ``documents``: each stage calls one operator of basketry.llm.

Every stage works on all rows that the stage before it kept, and its decisions
take effect; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm.common import fewer_files, prepare, table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier rejects (score under 0.3) go."""
    from basketry.llm.pu_quality import accepted

    prepare(spark)
    return accepted(fewer_files(docs, 2), table(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five-word shingles, similarity 0.8 or more)."""
    from basketry.llm.hyperminhash import deduplicated

    prepare(spark)
    return deduplicated(docs, words=5, percent=80)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; no document goes."""
    from basketry.llm.secrets import redacted

    prepare(spark)
    return redacted(fewer_files(docs, 2))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source's target weight takes it."""
    from basketry.llm.mixing import mixed

    prepare(spark)
    return mixed(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_chars, ids, n_tokens, decoded_sha256): the encoded corpus, and a digest of what its ids decode to.

    Rows are gathered below the Python step: every task runs one Python stream.
    """
    from basketry.llm.bpe import decode, encode
    from basketry.llm.queries import tokenizer

    prepare(spark)
    path = tokenizer("byte_bpe_50k.json")
    rows = decode(encode(fewer_files(docs, 2), path).drop("text"), path)
    return rows.withColumns({"n_tokens": F.size("ids").cast("long"), "decoded_sha256": F.sha2("decoded", 256)}).drop("decoded")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
    ("bpe_encoding", bpe_encoding),
]

#: The classifier and the encoding have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after another; every stage's rows are written as Parquet and read back."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
