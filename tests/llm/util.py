"""Small inputs that every operator must take, and helpers."""

from __future__ import annotations

import hashlib
import random

SF = "/root/testdata/sf0.001"
#: Columns of documents, and extra ones named like those that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, h string, size string, score string, spans string, ids string, component string, bucket string, term string"


def words(n: int, seed: int = 0) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(n))


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), 1, "x", None, "s", "t", "u", "c", "b", "t")


LONG = words(60_000, 7)


def edge_rows() -> list[tuple]:
    """Nulls, empty and very long texts, ties, repeated rows."""
    base = words(120, 1)
    return [
        row(1, base),
        row(2, base),
        row(3, base + " tail"),
        row(4, None, None, None),
        row(5, ""),
        row(6, " \t\n "),
        row(7, "word"),
        row(8, "two words"),
        row(9, "two words"),
        row(9, "two words"),
        row(10, LONG),
        row(11, LONG + " more"),
        row(12, "é" * 300 + " \U0001f600 ñandú", None, "b"),
        row(None, words(50, 3)),
        row(None, None, None, None),
        row(13, words(90, 4), "de", None),
        row(14, "a" * 5000),
    ]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def key(r) -> tuple:
    return (r[0] is None, r[0] or 0, r[1] or "")


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def documents(spark, sf: str = SF) -> dict:
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
