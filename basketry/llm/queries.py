"""The registered queries op1 to op13: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gathered, prepare, table


def op1_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of documents: three-word shingles, similarity 0.85 or more."""
    from .hyperminhash import near_duplicates

    return near_duplicates(table(prepare(spark), sf_dir, "documents"), words=3, percent=85)


def op2_token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents through a digest cache (new for each call)."""
    from .token_cache import token_counts

    return token_counts(table(prepare(spark), sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), limit=512)


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of all documents and of their edited texts."""
    from .imatch import fingerprints

    return fingerprints(table(prepare(spark), sf_dir, "documents"))


def op4_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by positive-unlabelled learning."""
    from .pu_quality import quality

    prepare(spark)
    return gathered(quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: base patterns and sliding-window entropy."""
    from .secrets import joined, scan

    docs = table(prepare(spark), sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = scan(docs).drop("text")

    def n(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    digest = F.sha2(joined("spans", base_only=True), 256).alias("base_sha256")
    return gathered(found).select("doc_id", n("assign"), n("access"), n("hex"), digest, joined("spans").alias("spans"), n("entropy"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents at the sources' target weights."""
    from .mixing import mix

    docs = table(prepare(spark), sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents by a learned lexicon."""
    from .toxicity import toxicity

    prepare(spark)
    return gathered(toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op8_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all embeddings with a cosine of 0.9 or more."""
    from .flat_graph import linked

    return linked(table(prepare(spark), sf_dir, "embeddings"), threshold=0.9)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents' texts, and their decoded texts, as digests."""
    from .bpe import decode, encode

    path = tokenizer("byte_bpe_50k.json")
    docs = table(prepare(spark), sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = decode(encode(docs, path).drop("text"), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    digests = rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    return gathered(digests)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents without those of repeated 200-byte strings."""
    from .suffix_dedup import without_repeats

    rows = without_repeats(table(prepare(spark), sf_dir, "documents"))
    return gathered(rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")))


def op11_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents without those of repeated 35-word windows."""
    from .recompression import without_repeats

    rows = without_repeats(table(prepare(spark), sf_dir, "documents"))
    return gathered(rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    from .prefix_trie import trie

    return trie(table(prepare(spark), sf_dir, "conversations")).drop("k1", "k2")


def op13_orchard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings by product quantisation with Orchard search."""
    from .orchard import vector_codes

    return vector_codes(table(prepare(spark), sf_dir, "embeddings")).drop("label")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2:3].isdigit()}
