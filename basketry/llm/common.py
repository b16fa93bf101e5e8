"""Shared helpers: session set-up, shared scratch tables, text batches, label folds."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.session import ensure_checkpoint_dir, ship_package

#: Bytes of text that a numpy kernel works on at once (a longer text forms a slice of its own).
SLICE_BYTES = 500_000
#: Rows that Spark hands to Python at once: whole texts, so far fewer than its default of 10 000.
BATCH_ROWS = 1000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: A Python worker that neither takes nor gives anything for so many seconds is ended, and its task runs again.
IDLE_SECONDS = 600
_IDLE_CONF = {"spark.sql.execution.pyspark.udf.idleTimeoutSeconds": str(IDLE_SECONDS), "spark.sql.execution.pyspark.udf.killOnIdleTimeout": "true"}

#: Parquet's vectored reads take a direct buffer as large as a column chunk in every reading thread and keep it;
#: with whole texts in a column these add up to more than the heap leaves.  A session that sets the key keeps its value.
_VECTORED = "parquet.hadoop.vectored.io.enabled"


def prepare(spark: SparkSession) -> SparkSession:
    """Shared checkpoint folder, package on the executors, smaller Arrow batches, plain Parquet reads, and an end for stalled Python workers (no result changes)."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    if not 0 < int(spark.conf.get(_BATCH_CONF)) <= BATCH_ROWS:
        spark.conf.set(_BATCH_CONF, str(BATCH_ROWS))
    for k, v in _IDLE_CONF.items():
        spark.conf.set(k, v)
    if spark.conf.get(_VECTORED, None) is None:
        spark.conf.set(_VECTORED, "false")
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def fewer_files(df: DataFrame, waves: int = 1) -> DataFrame:
    """``df`` in at most ``waves`` partitions a core, for what is written by a light last stage: no shuffle, fewer and larger files."""
    return df.coalesce(waves * df.sparkSession.sparkContext.defaultParallelism)


def gathered(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly to one partition a core: a heavy last stage keeps its many tasks, its (smaller) rows go to few files."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def written(df: DataFrame, name: str, large: bool = False) -> DataFrame:
    """Write ``df`` in the shared folder and read it back: cuts the lineage, survives lost executors.

    ``large`` tables are written by the tasks that make them, without another shuffle.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (fewer_files(df, 4) if large else gathered(df)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed and kept in the checkpoint folder (small frames; ``written`` is more compact)."""
    return fewer_files(df).checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string) with null texts as empty; other columns are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fold(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod`` (null id: null)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(mod)


def text_slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a record batch into slices of about ``limit`` bytes of text, never within a text."""
    col = batch.column(batch.schema.get_field_index(column))
    _, off = utf8(col)
    first, n = 0, len(col)
    while first < n:
        last = int(np.searchsorted(off, off[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield batch.slice(first, last - first)
        first = last


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values one after another, and the n + 1 offsets into them (nulls are empty)."""
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64, count=n + 1, offset=col.offset * 8)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def strings(col: pa.Array) -> list[str]:
    return [x or "" for x in col.to_pylist()]
