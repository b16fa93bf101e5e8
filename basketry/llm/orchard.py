"""Vector codes by product quantisation; nearest codebook entries by Orchard search.

A vector's components become whole numbers, floor(256 * x), and the vector is
cut into 16 consecutive parts; each part position has a codebook of up to 64
entries, and a vector's code names the nearest entry of each of its parts.

Nearest entries are found by Orchard's search: every entry keeps the list of
all entries by their distance from it.  A search holds a best entry and walks
down its list; an entry nearer to the part becomes the best one and its list is
walked next; entries met before are marked and skipped; where the list is
beyond twice the current distance, no entry further on can be nearer, and the
search stops.  In squared whole numbers that is ``gap > 4 * distance``, so the
result is exact, ties included.  All parts of a batch walk in step.

Codebooks are a model of bounded size (16 x 64 entries a vector length).  Each
round is one job: tasks assign their parts and send sums per entry, which Spark
adds up.  Vectors of different lengths have codebooks of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Whole components are held within this bound (vectors of |x| < 2**18 never meet it), so that errors fit a long.
BOUND = 1 << 26
#: The table of label errors is broadcast up to this number of rows, else joined by a shuffle.
BROADCAST_LABELS = 100_000


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding array<double>, length): rows without null or non-finite components."""
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.where(F.col("embedding").isNotNull()).where(~bad).withColumn("length", F.size("embedding"))


def whole(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) as whole numbers."""
    return np.clip(np.floor(x * float(SCALE)), -BOUND, BOUND).astype(np.int64)


def cuts(length: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """Start and end of each part (equal, or as nearly so as the length allows)."""
    return [(i * length // parts, (i + 1) * length // parts) for i in range(parts)]


def neighbour_lists(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every entry all entries by distance from it, and these squared distances."""
    gap = ((book[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    order = np.argsort(gap, axis=1, kind="stable")
    return order, np.take_along_axis(gap, order, axis=1)


def orchard(x: np.ndarray, book: np.ndarray, lists: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry of each row of x (ties: the lower index), its squared distance, and the distances computed."""
    order, gap = lists or neighbour_lists(book)
    n, k = len(x), len(book)
    start = int(gap.sum(axis=1).argmin())
    best = np.full(n, start)
    dist = ((x - book[start]) ** 2).sum(axis=1)
    seen = np.zeros((n, k), bool)
    seen[:, start] = True
    at = np.zeros(n, np.int64)
    live, computed = np.arange(n), n
    while len(live):
        p, c = best[live], at[live]
        on = c < k
        on[on] = gap[p[on], c[on]] <= 4 * dist[live[on]]
        live, p, c = live[on], p[on], c[on]
        entry = order[p, c]
        at[live] = c + 1
        new = ~seen[live, entry]
        rows, entry = live[new], entry[new]
        seen[rows, entry] = True
        d = ((x[rows] - book[entry]) ** 2).sum(axis=1)
        computed += len(rows)
        better = (d < dist[rows]) | ((d == dist[rows]) & (entry < best[rows]))
        rows = rows[better]
        best[rows], dist[rows], at[rows] = entry[better], d[better], 0
    return best, dist, computed


def _matrices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, whole vectors) of a batch, for each vector length in it."""
    col = batch.column(column)
    size = np.asarray(col.value_lengths())
    flat = np.asarray(col.flatten(), dtype=np.float64)
    first = np.cumsum(size) - size
    for length in np.unique(size):
        rows = np.flatnonzero(size == length)
        yield int(length), rows, whole(flat[first[rows][:, None] + np.arange(length)[None, :]])


def _assigned(x: np.ndarray, books: list[np.ndarray], lists: list) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of every part of every vector."""
    got = [orchard(x[:, a:b], book, near) for (a, b), book, near in zip(cuts(x.shape[1]), books, lists)]
    return np.column_stack([g[0] for g in got]), np.column_stack([g[1] for g in got])


Books = dict[int, list[np.ndarray]]


def seeds(rows: DataFrame) -> Books:
    """Codebooks that start as the parts of the 64 smallest vec_ids of each length (null ids last; ties by components)."""
    books: Books = {}
    for length in sorted(r[0] for r in rows.select("length").distinct().collect()):
        first = rows.where(F.col("length") == length).orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES)
        got = first.select("embedding").collect()
        x = whole(np.array([r[0] for r in got], dtype=np.float64).reshape(len(got), length))
        books[length] = [x[:, a:b] for a, b in cuts(length)]
    return books


SUMS = "length int, part int, entry int, place int, total long"


def refined(rows: DataFrame, books: Books) -> Books:
    """One round: parts go to their nearest entry, entries to floor(sum / count) of theirs; unused entries stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = {length: [neighbour_lists(b) for b in bs] for length, bs in books.items()}
        sums = {length: [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in bs] for length, bs in books.items()}
        for batch in batches:
            for length, _, x in _matrices(batch, 0):
                entry, _ = _assigned(x, books[length], lists[length])
                for part, (a, b) in enumerate(cuts(length)):
                    own = np.column_stack([np.ones(len(x), np.int64), x[:, a:b]])  # the count stands at place 0
                    np.add.at(sums[length][part], entry[:, part], own)
        for length, parts in sums.items():
            for part, total in enumerate(parts):
                entry, place = np.nonzero(total[:, :1] * np.ones(total.shape[1], bool))
                if len(entry):
                    cols = [np.full(len(entry), length, np.int32), np.full(len(entry), part, np.int32), entry.astype(np.int32), place.astype(np.int32), total[entry, place]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["length", "part", "entry", "place", "total"])

    sums = rows.select("embedding").mapInArrow(run, SUMS)
    got = sums.groupBy("length", "part", "entry", "place").agg(F.sum("total").cast("long").alias("total")).collect()
    total = {(r["length"], r["part"], r["entry"], r["place"]): r["total"] for r in got}
    out = {length: [b.copy() for b in bs] for length, bs in books.items()}
    for (length, part, entry, place), value in total.items():
        if place:
            out[length][part][entry, place - 1] = value // total[length, part, entry, 0]
    return out


def trained(rows: DataFrame, rounds: int = ROUNDS) -> Books:
    books = seeds(rows)
    for _ in range(rounds):
        books = refined(rows, books)
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and place."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


CODED = "vec_id long, label {label}, code string, error long, codebooks_sha256 string"


def coded(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code, error, codebooks_sha256) of every usable row of ``vectors`` (vec_id, embedding, label).

    Rows whose vector is null or holds null or non-finite components are left
    out; an empty vector has code 00 in every part and error 0.  Repeated rows
    count each.  Of fewer than 64 vectors, codebooks hold as many entries.  A
    length that 16 does not divide is cut into parts as equal as may be.  No
    usable row: no rows.  Other columns are left behind.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    rows = usable(vectors)
    books = trained(rows, rounds)
    digests = {length: digest(bs) for length, bs in books.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = {length: [neighbour_lists(b) for b in bs] for length, bs in books.items()}
        hex2 = np.array([f"{i:02x}" for i in range(ENTRIES)])
        for batch in batches:
            for length, at, x in _matrices(batch, 2):
                entry, dist = _assigned(x, books[length], lists[length])
                code = ["".join(r) for r in hex2[entry].tolist()]
                ids = batch.take(pa.array(at))
                cols = [ids.column(0), ids.column(1), pa.array(code), pa.array(dist.sum(axis=1)), pa.array([digests[length]] * len(at))]
                yield pa.RecordBatch.from_arrays(cols, ["vec_id", "label", "code", "error", "codebooks_sha256"])

    return rows.select("vec_id", "label", "embedding").mapInArrow(run, CODED.format(label=dict(rows.dtypes)["label"]))


def vector_codes(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``coded`` with label_error, the error summed over the rows of equal labels (null labels together)."""
    rows = written(coded(vectors, rounds), "codes")
    per = written(rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").cast("long").alias("label_error")), "label-errors")
    if per.count() <= BROADCAST_LABELS:
        per = F.broadcast(per)
    both = rows.join(per, F.col("label").eqNullSafe(F.col("_label")))
    return both.select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")
