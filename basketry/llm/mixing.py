"""Mixing sources to target weights.

Tokens (words) are summed per source; a source's target is its weight's share
of the mix, stopped at a multiple of its size with the excess shared anew; a
source's repetition rate is target / size.  Each document is taken floor(rate)
times, plus once more by a Bernoulli draw of its own with probability
frac(rate), seeded by a hash of the document: no window, no order, no other
document has a say in it.

A few long documents can throw a small source far off its target whatever the
generator.  So a document has not one seed but SEEDS of them (from one digest,
a pairwise independent family), one grouped aggregate sums what each seed would
take of each source, and every source is drawn with the seed that comes
nearest to its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, fewer_files, written

#: Weights of the sources in code point order, repeating; share of all words that the mix takes; most repetitions.
WEIGHTS, TAKE_PERCENT, MOST = (5, 2, 1), 150, 2
#: The table of sources is broadcast up to this number of rows, else joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: Seeds of a document, and the modulus of their family (a prime below 2**31).
SEEDS, PRIME = 32, 2_147_483_647
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _numbers(doc_id: Column, text: Column, seed: str) -> tuple[Column, Column]:
    """Two numbers below PRIME from a digest of a document (its id and text)."""
    digest = F.md5(F.concat_ws("\x01", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))
    a, b = (F.conv(F.substring(digest, i, 8), 16, 10).cast("long") % PRIME for i in (1, 9))
    return a, b


def unit(a: Column, b: Column, nth: Column) -> Column:
    """A document's number in [0, 1) under one of its seeds."""
    return ((a * nth + b) % PRIME).cast("double") / F.lit(float(PRIME))


def targets(sources: DataFrame, weights: tuple = WEIGHTS, percent: int = TAKE_PERCENT, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size, ...) with weight and target.

    One row per source.  Each round shares what is left by weight among the
    open sources and closes those above their bound; a round is one aggregate,
    and there are at most as many rounds as sources (three or four in practice).
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(order) - 1) % len(weights) + 1
    rows = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), nth).cast("long"))
    rows = checkpointed(rows.withColumn("bound", F.col("source_size") * most))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    closed, left, weight, n = F.lit(False), total * percent / 100, 0, -1
    while True:
        got = rows.agg(
            F.sum(F.when(closed, F.col("bound")).otherwise(0)).alias("used"),
            F.sum(F.when(closed, 0).otherwise(F.col("weight"))).alias("weight"),
            F.sum(F.when(closed, 1).otherwise(0)).alias("n"),
        ).first()
        used, weight, now = got["used"] or 0, got["weight"] or 0, got["n"] or 0
        if now == n or not weight:
            break
        n, left = now, total * percent / 100 - used
        # exact in whole numbers: bound / weight < left / weight of all open sources
        closed = F.col("bound") * F.lit(weight) < F.lit(left) * F.col("weight")
    share = F.lit(left / weight) * F.col("weight") if weight else F.col("bound").cast("double")
    return rows.withColumn("target", F.when(closed, F.col("bound").cast("double")).otherwise(F.least(share, F.col("bound").cast("double"))))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, percent: int = TAKE_PERCENT, most: int = MOST, seed: str = "mix") -> DataFrame:
    """``docs`` with size, source_size, target, rate and copies (how often the mix takes the row).

    Null text: size 0; null sources form one source, last in order; sources of
    size 0 have rate 0; an empty table gives no rows.  Rows that repeat id and
    text are drawn alike, rows of one id (null, too) and different texts on
    their own.  All columns of ``docs`` stay, but those named like a new one,
    which are replaced.
    """
    keep = [c for c in docs.columns if c not in ("size", "source_size", "target", "rate", "copies")]
    return _mix(docs, weights, percent, most, seed).select(*[F.col(f"row.`{c}`") for c in keep], "size", "source_size", "target", "rate", "copies")


def _mix(docs: DataFrame, weights: tuple = WEIGHTS, percent: int = TAKE_PERCENT, most: int = MOST, seed: str = "mix") -> DataFrame:
    """(row, size, source_size, target, rate, copies): ``row`` holds all columns of ``docs``, whatever their names."""
    a, b = _numbers(F.col("doc_id"), F.col("text"), seed)
    small = written(docs.select("source", words(F.col("text")).alias("size"), a.alias("a"), b.alias("b")), "sizes", large=True)
    per = small.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = targets(per, weights, percent, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    per = checkpointed(per.select(F.col("source").alias("of"), "source_size", "target", rate.alias("rate")))
    few = per.count() <= BROADCAST_SOURCES
    side = F.broadcast(per) if few else per
    part = F.col("rate") - F.floor("rate")
    drawn = [F.sum(F.when(unit(F.col("a"), F.col("b"), F.lit(k)) < part, F.col("size")).otherwise(0)).alias(f"s{k}") for k in range(1, SEEDS + 1)]
    sums = small.join(side, F.col("source").eqNullSafe(F.col("of"))).groupBy("of", "source_size", "target", "rate").agg(*drawn)
    # the seed whose draw lies nearest to what is left of the target (the first of equals)
    off = lambda k: F.abs(F.col(f"s{k}") + F.floor("rate") * F.col("source_size") - F.col("target"))
    best = F.array_min(F.array(*[F.struct(off(k).alias("off"), F.lit(k).alias("k")) for k in range(1, SEEDS + 1)]))["k"]
    per = checkpointed(sums.select("of", "source_size", "target", "rate", best.alias("seed")))
    side = F.broadcast(per) if few else per
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.join(side, F.col("row.source").eqNullSafe(F.col("of")))
    a, b = _numbers(F.col("row.doc_id"), F.col("row.text"), seed)
    copies = F.floor("rate") + F.when(unit(a, b, F.col("seed")) < part, 1).otherwise(0)
    out = rows.select("row", words(F.col("row.text")).alias("size"), "source_size", "target", "rate", copies.cast("long").alias("copies"))
    return fewer_files(out, 2)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as ``mix`` takes it, with the columns of ``docs``."""
    taken = _mix(docs, **options).where("copies > 0")
    each = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(*[F.col(f"row.`{c}`") for c in docs.columns])
