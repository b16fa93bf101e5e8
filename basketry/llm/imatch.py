"""Document fingerprints: I-Match over randomised lexicon subsets, in DataFrame functions only.

Terms are the distinct lower-cased runs of letters and digits of a text, each
stood for by its 64-bit hash.  The lexicon holds the terms whose document
frequency lies in a band (neither common nor rare: a band of inverse document
frequencies).  A fingerprint has one part per lexicon subset: the hash of the
text's sorted terms of that subset, empty if it has none.  Subsets are random
and of several rates (a quarter of the lexicon down to one in 1024), so that
long texts have parts with few terms, which a small edit leaves alone.  A text
with no term in any subset is stood for by its whole text.

The successor of each document in id order comes from one shuffle: rows are
dealt to buckets of id ranges, and the first row of each bucket is also sent,
as a ghost, to the end of the bucket before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, gathered

#: Least and largest share of the documents that hold a lexicon term (and at least two documents).
MIN_SHARE, MAX_SHARE = 0.001, 0.1
#: One random subset for each entry r, holding a share 2**-r of the lexicon.
RATES = (2, 3, 4, 4, 5, 5, 5, 6, 6, 6, 6, 7, 7, 7, 7, 8, 8, 8, 8, 9, 9, 9, 10, 10)
#: Id buckets: a grid of quantiles, each cut further where it would hold more rows than this.
GRID, BUCKET_ROWS = 32, 50_000
#: The table of first ids (one row a bucket, at most GRID**2 times this number) is broadcast up to here.
BROADCAST_FINER = 1000
#: The lexicon is broadcast up to this number of terms (16 bytes each), else joined by a shuffle.
BROADCAST_TERMS = 2_000_000

_TERM = r"[^\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """Distinct terms of a text."""
    return F.array_distinct(F.filter(F.split(F.lower(text), _TERM), lambda t: t != ""))


def _split_terms(text: Column) -> Column:
    """As above and the empty string, which stands for the text itself and is in no lexicon."""
    return F.array_distinct(F.concat(F.split(F.lower(text), _TERM), F.array(F.lit(""))))


def lexicon(texts: DataFrame, min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> DataFrame:
    """(term long, subsets long): hash of each term in the band and the bits of the subsets it is in.

    Every document of ``texts`` (column text) counts.  The table has at most
    (distinct terms per document on average) / min_share rows whatever the
    number of documents.
    """
    n = texts.count()
    counts = texts.select(F.explode(_split_terms(F.col("text"))).alias("t")).where("t <> ''").groupBy(F.xxhash64("t").alias("term")).count()
    band = counts.where((F.col("count") >= max(2, min_share * n)) & (F.col("count") <= max(2, max_share * n)))
    bits = F.lit(0).cast("long")
    for j, r in enumerate(RATES):
        member = F.pmod(F.xxhash64("term", F.lit(j)), F.lit(1 << r)) == 0
        bits = bits.bitwiseOR(F.when(member, F.lit(1 << j).cast("long")).otherwise(F.lit(0).cast("long")))
    return band.select("term", bits.alias("subsets"))


def parts(found: Column, fallback: Column) -> Column:
    """Array of the fingerprint's parts from the sorted lexicon terms found (structs of term and subsets).

    A text without a lexicon term in any subset has the hash of its whole text as first part.
    """

    def part(bit: int) -> Column:
        sub = F.filter(found, lambda t: t["subsets"].bitwiseAND(F.lit(bit)) != 0)
        return F.when(F.size(sub) > 0, F.hex(F.xxhash64(sub))).otherwise("")

    each = [part(1 << j) for j in range(len(RATES))]
    whole = [F.concat(F.lit("text:"), F.hex(fallback)), *[F.lit("")] * (len(each) - 1)]
    return F.when(F.exists(found, lambda t: t["subsets"] != 0), F.array(*each)).otherwise(F.array(*whole))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal parts among those that either fingerprint has; 0 against a missing one."""
    seen = F.zip_with(a, b, lambda x, y: (F.when((x == "") & (y == ""), 0).otherwise(1)))
    same = F.zip_with(a, b, lambda x, y: F.when((x == y) & (x != ""), 1).otherwise(0))

    def total(c: Column) -> Column:
        return F.aggregate(c, F.lit(0), lambda s, x: s + x)

    return F.coalesce(total(same) / F.greatest(total(seen), F.lit(1)), F.lit(0.0)).cast("double")


def with_next_text(docs: DataFrame) -> DataFrame:
    """(bucket, ghost, doc_id, text, tie, next): each row with the text of the next doc_id, after the last the first.

    Ghost rows (copies of the next bucket's first rows) stay in, at the end of
    their bucket.  Rows of one doc_id are ordered by their text's hash.  A null
    doc_id is outside the order: its next text is empty.
    """
    bounds = docs.agg(
        F.percentile_approx("doc_id", [i / GRID**2 for i in range(1, GRID**2)], 20 * GRID**2).alias("q"),
        F.min("doc_id").alias("lo"),
        F.max("doc_id").alias("hi"),
        F.count("doc_id").alias("n"),
    ).first()
    rows = docs.withColumn("tie", F.xxhash64("text"))
    if not bounds["n"]:
        return rows.select(F.lit(0).cast("long").alias("bucket"), F.lit(0).alias("ghost"), "doc_id", "text", "tie", F.lit("").alias("next"))
    q = [bounds["lo"], *bounds["q"]]
    finer = -(-bounds["n"] // (GRID**2 * BUCKET_ROWS))

    def place(values: Column, x: Column) -> Column:
        return F.size(F.filter(values, lambda b: b <= x)) - 1

    coarse = F.array(*map(F.lit, q[::GRID]))
    grid = F.array(*[F.array(*map(F.lit, q[i : i + GRID])) for i in range(0, len(q), GRID)])
    x = F.col("doc_id")
    rows = rows.withColumn("_c", place(coarse, x))
    cell = F.col("_c") * GRID + place(F.element_at(grid, F.col("_c") + 1), x)
    rows = rows.withColumn("_cell", cell.cast("long"))
    if finer > 1:
        ends = F.array(*map(F.lit, [*q, bounds["hi"] + 1]))
        lo, hi = F.element_at(ends, F.col("_cell").cast("int") + 1), F.element_at(ends, F.col("_cell").cast("int") + 2)
        at = F.floor((x - lo) / F.greatest(hi - lo, F.lit(1)) * finer)
        rows = rows.withColumn("_cell", F.col("_cell") * finer + F.least(at, F.lit(finer - 1)))
    rows = rows.withColumn("bucket", F.when(x.isNull(), -1 - F.pmod("tie", F.lit(1024))).otherwise(F.col("_cell"))).drop("_c", "_cell")
    # the first id of each bucket goes to the bucket before it, that of the first bucket to the last
    firsts = rows.where("doc_id is not null").groupBy("bucket").agg(F.min("doc_id").alias("_first"))
    order = Window.orderBy("bucket")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select(F.col("bucket").alias("_b"), "_first", F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(whole)).alias("_before"))
    if finer <= BROADCAST_FINER:
        firsts = F.broadcast(firsts)
    rows = rows.join(firsts, (F.col("bucket") == F.col("_b")) & (F.col("doc_id") == F.col("_first")), "left")
    places = F.when(F.col("_before").isNull(), F.array(F.struct(F.col("bucket"), F.lit(0).alias("ghost"))))
    places = places.otherwise(F.array(F.struct(F.col("bucket"), F.lit(0).alias("ghost")), F.struct(F.col("_before").alias("bucket"), F.lit(1).alias("ghost"))))
    rows = rows.select(F.explode(places).alias("_p"), "doc_id", "text", "tie").select("_p.bucket", "_p.ghost", "doc_id", "text", "tie")
    follow = F.coalesce(F.lead("text").over(_in_order()), F.lit(""))
    return rows.withColumn("next", F.when(F.col("doc_id").isNull(), "").otherwise(follow))


def _in_order():
    return Window.partitionBy("bucket").orderBy("ghost", "doc_id", "tie")


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last floor(n / 4) code points replaced by the first as many (or all) of ``following``."""
    cut = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - cut), F.substring(following, F.lit(1), cut))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    Null texts are empty; equal texts have equal fingerprints; repeated rows
    follow each other in id order and are each other's next document; a null
    doc_id has no next document (near_next 0); an empty table gives no rows;
    other columns are left behind.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # the empty string joins, too, so that no text is lost; it carries what is known of the text
    mark = docs.sparkSession.range(1).select(F.xxhash64(F.lit("")).alias("term"), F.lit(None).cast("long").alias("subsets"))
    words = checkpointed(lexicon(docs).unionByName(mark))
    if words.count() <= BROADCAST_TERMS:
        words = F.broadcast(words)
    rows = with_next_text(docs)
    rows = rows.withColumn("edit", F.when(F.col("ghost") == 1, "").otherwise(edited(F.col("text"), F.col("next"))))
    rows = rows.withColumn("_row", F.row_number().over(_in_order()))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")), F.struct(F.lit(1).alias("side"), F.col("edit").alias("t"))))
    own = ("bucket", "_row", "ghost", "doc_id", "tie", F.length("text").cast("long").alias("n_chars"))
    two = rows.select(*own, F.unhex(F.sha2("edit", 256)).alias("sha"), F.xxhash64("edit").alias("edit_tie"), sides.alias("s"))
    known = ("ghost", "doc_id", "tie", "n_chars", "sha", "edit_tie")
    each = two.select("bucket", "_row", *known, "s.side", F.explode(_split_terms(F.col("s.t"))).alias("_t"))
    own = F.col("_t") == ""
    each = each.select("bucket", "_row", "side", F.xxhash64("_t").alias("term"), *[F.when(own, F.col(c)).alias(c) for c in known])
    hit = each.join(words, "term")
    entry = F.struct("term", "subsets")
    keep = F.col("subsets").isNotNull()
    got = hit.groupBy("bucket", "_row").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in known],
        F.sort_array(F.collect_list(F.when(keep & (F.col("side") == 0), entry))).alias("found"),
        F.sort_array(F.collect_list(F.when(keep & (F.col("side") == 1), entry))).alias("edit_found"),
    )
    got = got.select("bucket", "ghost", "doc_id", "tie", "n_chars", "sha", parts(F.col("found"), F.col("tie")).alias("p"), parts(F.col("edit_found"), F.col("edit_tie")).alias("e"))
    got = got.withColumn("_next", F.when(F.col("doc_id").isNotNull(), F.lead("p").over(_in_order()))).where("ghost = 0")
    out = got.select(
        "doc_id",
        "n_chars",
        F.lower(F.hex("sha")).alias("edited_sha256"),
        F.array_join("p", ".").alias("fingerprint"),
        F.array_join("e", ".").alias("edited_fingerprint"),
        likeness(F.col("p"), F.col("e")).alias("near_edited"),
        likeness(F.col("p"), F.col("_next")).alias("near_next"),
    )
    return gathered(out)
