"""Window operators that stay balanced when one key holds a large share of rows.

A window partitioned by a key sends each whole key group to one task.  With
a customer or a category holding a third of all rows that task becomes the
job.  The operators here give the same results as the plain windows but cut
heavy keys into order-preserving sub-buckets:

1. candidate heavy keys from a sample, then exact row counts of the
   candidates (partial aggregates);
2. keys with more than ``heavy_rows`` rows get bucket boundaries from a sorted
   sample of their (order value, tie-breaker) pairs, about ``bucket_rows`` rows
   apart; any orderable types will do, strings and dates included;
3. light keys run the plain window (each at most ``heavy_rows`` rows);
   heavy keys run it per (key, bucket) — bounded groups;
4. a per-(key, bucket) summary of the heavy keys (count, sum, last value)
   gets prefix offsets with a window over the buckets of one key;
5. the offsets (one row per heavy bucket) join back to the heavy rows, which
   are partitioned by (key, bucket) already.

A RANGE running sum first adds up equal values of a heavy key, so one value
that very many rows share is one row, too.

The frames that travel (heavy keys, boundaries) hold at most N / bucket_rows
values; they are broadcast up to ``basketry.broadcast.maxBytes``, else joined by
a shuffle.  They are checkpointed, nothing stays cached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .joins import join_small

DEFAULT_HEAVY_ROWS = 2_000_000
DEFAULT_BUCKET_ROWS = 500_000
DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024
SAMPLE_HITS = 1000  # expected sampled rows of a key at the heavy threshold
SAMPLES_PER_BUCKET = 32
MAX_BUCKETS = 4096  # of one key; above, its buckets grow
FINE = 64  # boundaries that are searched at once
BOUNDARY_BYTES = 64  # of one boundary or heavy key, roughly
SAMPLE_SEED = 17
_EPOCH = "1970-01-01 00:00:00"

_B = "__bkt"
_K = "__key"  # struct(key): groups and joins NULL keys like a window partition does
_H = "__heavy"  # row belongs to a heavy key


def _conf_int(df: DataFrame, key: str, default: int) -> int:
    v = df.sparkSession.conf.get(key, None)
    return int(v) if v else default


def skew_limits(df: DataFrame) -> tuple[int, int]:
    """(heavy_rows, bucket_rows) from the session, with defaults."""
    heavy = _conf_int(df, "basketry.skew.heavyRows", DEFAULT_HEAVY_ROWS)
    bucket = _conf_int(df, "basketry.skew.bucketRows", DEFAULT_BUCKET_ROWS)
    return heavy, max(1, min(bucket, heavy))


def _small(df: DataFrame, side: DataFrame, values: int) -> DataFrame:
    """``side`` with a broadcast hint if its ``values`` boundaries or keys are under the byte bound."""
    limit = _conf_int(df, "basketry.broadcast.maxBytes", DEFAULT_BROADCAST_BYTES)
    return F.broadcast(side) if values * BOUNDARY_BYTES <= limit else side


def _order_number(c: Column, kind: str) -> Column:
    """The order value as boundaries hold it: microseconds for timestamps, else the value itself."""
    if kind == "timestamp":
        return F.timestamp_diff("MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), c).cast("double")
    return c


def _heavy_keys(df: DataFrame, by: str) -> tuple[DataFrame, int] | None:
    """Keys (``by``, ``__n``) with more than heavy_rows rows, and their number; None without any.

    Candidates come from a sample: a key with more than heavy_rows rows shows
    about SAMPLE_HITS sampled rows, so the per-key count shuffles a sample
    instead of every row.  A key the sample misses is still processed
    correctly, as a light key.
    """
    heavy_rows, _ = skew_limits(df)
    ensure_checkpoint_dir(df.sparkSession)
    rate = min(1.0, SAMPLE_HITS / heavy_rows)
    scope = df.select(by)
    if rate < 1.0:
        hits = scope.sample(withReplacement=False, fraction=rate, seed=SAMPLE_SEED).groupBy(by).agg(F.count(F.lit(1)).alias("__s"))
        cand = hits.where(F.col("__s") >= SAMPLE_HITS // 2).select(by).checkpoint()
        n = cand.count()
        if not n:
            return None
        scope = scope.join(_small(df, cand, n), by, "left_semi")
    keys = scope.groupBy(by).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > heavy_rows).checkpoint()
    n = keys.count()
    return (keys, n) if n else None


def _bounds(rows: DataFrame, by: str, value: Column) -> tuple[DataFrame, int]:
    """(``by``, ``__bounds``, ``__coarse``) from a sample of ``rows`` (with ``__n``); and the number of boundaries.

    ``__bounds`` are about n / bucket_rows values of ``value`` at even ranks of
    the sample, ``__coarse`` every FINE-th of them.
    """
    _, bucket_rows = skew_limits(rows)
    step = F.greatest(F.lit(bucket_rows), F.ceil(F.col("__n") / MAX_BUCKETS))
    rate = F.least(F.lit(1.0), F.lit(float(SAMPLES_PER_BUCKET)) / step)
    picked = rows.where(F.rand(SAMPLE_SEED) < rate)
    sample = picked.groupBy(by).agg(F.sort_array(F.collect_list(value)).alias("__s"), F.first("__n").alias("__n"))
    every = F.greatest(F.lit(1), F.ceil(F.size("__s") * step / F.col("__n"))).cast("int")
    sample = sample.withColumn("__every", every)
    # one boundary at each rank that starts a bucket
    bounds = F.filter("__s", lambda x, i: (i > 0) & (i % F.col("__every") == 0))
    sample = sample.select(by, bounds.alias("__bounds"))
    coarse = F.filter("__bounds", lambda x, i: i % FINE == 0)
    got = sample.select(by, "__bounds", coarse.alias("__coarse")).checkpoint()
    return got, got.agg(F.sum(F.size("__bounds") + 1)).first()[0] or 0


def _bucket(value: Column) -> Column:
    """Number of boundaries at or below the value, in two steps."""
    c = F.size(F.filter("__coarse", lambda x: x <= value))
    near = F.slice("__bounds", (F.greatest(c, F.lit(1)) - 1) * FINE + 1, FINE)
    return F.when(c == 0, F.lit(0)).otherwise((c - 1) * FINE + F.size(F.filter(near, lambda x: x <= value))).cast("bigint")


def _sort_value(order: Column, tie: Column | None) -> Column:
    """The sort position (order NULLS LAST, tie) as one comparable value."""
    parts = [order.isNull().alias("z"), order.alias("o")]
    return F.struct(*parts, *([tie.alias("t")] if tie is not None else []))


def _with_buckets(df: DataFrame, by: str, order: Column, tie: Column | None = None) -> tuple[DataFrame, bool]:
    """Add ``__bkt``: 0 for light keys, an order-preserving bucket of about bucket_rows rows for heavy keys.

    Buckets are monotone in (order NULLS LAST, tie), and equal pairs share one.
    Also says whether there is any heavy key; if so, ``__heavy`` marks its rows.
    """
    found = _heavy_keys(df, by)
    if found is None:
        return df.withColumn(_B, F.lit(0).cast("bigint")), False
    keys, n = found
    value = _sort_value(order, tie)
    heavy = df.join(_small(df, keys, n), by)
    bounds, n_bounds = _bounds(heavy, by, value)
    light = df.join(_small(df, keys.select(by), n), by, "left_anti")
    light = light.withColumn(_B, F.lit(0).cast("bigint")).withColumn(_H, F.lit(False))
    heavy = heavy.drop("__n").join(_small(df, bounds, n_bounds), by).withColumn(_B, _bucket(value)).withColumn(_H, F.lit(True))
    return light.unionByName(heavy.drop("__bounds", "__coarse")), True


def ordered_sequence(
    df: DataFrame,
    by: str,
    order: str,
    tie: str,
    seq: str = "order_sequence",
    prev: str = "previous_value",
    group_rows: str = "group_rows",
) -> DataFrame:
    """Per ``by`` ordered by (``order`` asc NULLS LAST, ``tie``): row number, previous ``order``
    value (lag) and group row count — the skew-safe form of

        row_number() / lag(order) / count(*) OVER (PARTITION BY by ORDER BY order, tie)
    """
    kind = "timestamp" if dict(df.dtypes)[order].startswith("timestamp") else "value"
    base = df.withColumn(_K, F.struct(by))
    b, split = _with_buckets(base, _K, _order_number(F.col(order), kind), F.col(tie))
    # light keys: the plain window, bounded by heavy_rows; only heavy keys need offsets
    w = Window.partitionBy(_K).orderBy(F.asc_nulls_last(order), F.asc(tie))
    light = (b.where(~F.col(_H)) if split else b).select(
        *df.columns,
        F.row_number().over(w).cast("bigint").alias(seq),
        F.lag(order).over(w).alias(prev),
        F.count(F.lit(1)).over(Window.partitionBy(_K)).cast("bigint").alias(group_rows),
    )
    if not split:
        return light
    w = Window.partitionBy(_K, _B).orderBy(F.asc_nulls_last(order), F.asc(tie))
    local = b.where(F.col(_H)).select("*", F.row_number().over(w).alias("__lseq"), F.lag(order).over(w).alias("__lprev"))
    summary = local.groupBy(_K, _B).agg(
        F.count(F.lit(1)).alias("__bn"),
        F.max(order).alias("__blast"),
        F.count(order).alias("__bnn"),
    )
    wk = Window.partitionBy(_K).orderBy(_B)
    offsets = summary.select(
        _K,
        _B,
        F.coalesce(F.sum("__bn").over(wk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"),
        # last value of the previous bucket: NULL if that bucket ended in NULL values
        F.lag(F.when(F.col("__bnn") == F.col("__bn"), F.col("__blast"))).over(wk).alias("__pprev"),
        F.sum("__bn").over(Window.partitionBy(_K)).alias("__tot"),
    )
    heavy = join_small(local, offsets, [_K, _B], "inner").select(
        *df.columns,
        (F.col("__off") + F.col("__lseq")).cast("bigint").alias(seq),
        F.when(F.col("__lseq") == 1, F.col("__pprev")).otherwise(F.col("__lprev")).alias(prev),
        F.col("__tot").cast("bigint").alias(group_rows),
    )
    return light.unionByName(heavy)


def running_total(
    df: DataFrame,
    by: str,
    value: str,
    running: str = "running_total",
    total: str = "group_total",
) -> DataFrame:
    """Running sum of ``value`` per ``by`` ordered by ``value`` DESC NULLS FIRST with the
    default RANGE frame (tied values share one running sum), plus the group total.

    Skew-safe form of ``sum(v) OVER (PARTITION BY by ORDER BY v DESC)`` and
    ``sum(v) OVER (PARTITION BY by)``.
    """
    base = df.withColumn(_K, F.struct(by))
    found = _heavy_keys(base, _K)
    w = Window.partitionBy(_K).orderBy(F.desc_nulls_first(value))
    whole = Window.partitionBy(_K)

    def plain(rows: DataFrame) -> DataFrame:
        span = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.select(*df.columns, F.sum(value).over(span).alias(running), F.sum(value).over(whole).alias(total))

    if found is None:  # every key has at most heavy_rows rows: the plain window is bounded
        return plain(base)
    keys, n = found
    light = plain(base.join(_small(df, keys.select(_K), n), _K, "left_anti"))
    heavy = base.join(_small(df, keys, n), _K)
    # equal values become one row each; descending order: bucket on -value so that bucket order is ascending
    values = heavy.groupBy(_K, value).agg(F.sum(value).alias("__s"), F.first("__n").alias("__n"))
    position = F.struct(F.col(value).isNotNull().alias("z"), (-F.col(value)).alias("o"))
    bounds, n_bounds = _bounds(values, _K, position)
    placed = values.join(_small(df, bounds, n_bounds), _K).withColumn(_B, _bucket(position)).select(_K, value, "__s", _B)
    inside = Window.partitionBy(_K, _B).orderBy(F.desc_nulls_first(value)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.select("*", F.sum("__s").over(inside).alias("__lrun"))
    summary = local.groupBy(_K, _B).agg(F.sum("__s").alias("__bs"))
    wk = Window.partitionBy(_K).orderBy(_B)
    offsets = summary.select(
        _K,
        _B,
        F.sum("__bs").over(wk.rowsBetween(Window.unboundedPreceding, -1)).alias("__off"),
        F.sum("__bs").over(Window.partitionBy(_K)).alias("__tot"),
    )
    run = F.when(F.col("__off").isNull(), F.col("__lrun")).otherwise(F.coalesce(F.col("__lrun"), F.lit(0)) + F.col("__off"))
    sums = join_small(local, offsets, [_K, _B], "inner").select(
        F.col(_K).alias("__k"), F.col(value).alias("__v"), run.alias(running), F.col("__tot").alias(total)
    )
    at = (F.col(_K) == F.col("__k")) & F.col(value).eqNullSafe(F.col("__v"))
    return light.unionByName(heavy.join(sums, at).select(*df.columns, running, total))


def with_group_stats(df: DataFrame, by: str | list[str], aggs: list[Column]) -> DataFrame:
    """Attach per-group aggregates to every row (``agg(...) OVER (PARTITION BY by)``).

    Computed as a partial aggregate plus a join back, never a window: the
    per-group table is broadcast when its size allows, else the join is a
    shuffle join with adaptive skew splitting.
    """
    keys = [by] if isinstance(by, str) else list(by)
    return join_small(df, df.groupBy(*keys).agg(*aggs), keys, "left")
