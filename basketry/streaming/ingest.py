"""Incremental CSV ingest with Structured Streaming.

The batch loader (``sources.files.ingest_dir`` + ``write_table``) re-reads
every file and replaces each raw table.  For a landing folder that keeps
receiving files, the same ingest runs as a file-source stream with the
``availableNow`` trigger: every run picks up only files not seen before and
writes them to the raw parquet table.  The file log and the batch number are
kept in a checkpoint beside the table (``<root>/_streams/<tier>/<name>``), the
same one for every run and process, so that a rerun after a failure neither
loses nor repeats rows.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..schemas import FREE_TEXT_TABLES
from ..sources.files import normalize_name, read_table, table_exists, table_path
from ..sources.versions import current


def stream_table(
    spark: SparkSession,
    landing: str,
    name: str,
    schema: T.StructType,
    root: str,
    tier: str = "raw",
    checkpoint: str | None = None,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Start an ``availableNow`` stream from CSV files in ``landing`` into ``<root>/<tier>/<name>``.

    Returns the started query; call ``awaitTermination()`` to wait for the
    files present at start to be processed.  A table that batch loads replace
    as a whole cannot be appended to.
    """
    if current(spark, table_path(root, tier, name)) is not None:
        raise ValueError(f"{tier}.{name} is replaced by versions; a stream needs a table of its own")
    reader = (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("mode", "FAILFAST")
        .option("escape", '"')
        .option("multiLine", name in FREE_TEXT_TABLES)
        # a file whose header differs from the schema fails instead of swapping columns
        .option("enforceSchema", False)
    )
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.csv(landing)
    src = src.toDF(*[normalize_name(c) for c in src.columns])
    ckpt = checkpoint or f"{root.rstrip('/')}/_streams/{tier}/{name}"
    return (
        src.writeStream.format("parquet")
        .option("path", table_path(root, tier, name))
        .option("checkpointLocation", ckpt)
        .outputMode("append")
        .trigger(availableNow=True)
        .queryName(f"ingest_{tier}_{name}")
        .start()
    )


def ingest_available(
    spark: SparkSession,
    landing: str,
    name: str,
    schema: T.StructType,
    root: str,
    tier: str = "raw",
    checkpoint: str | None = None,
) -> int:
    """Process every not-yet-ingested file in ``landing`` and return the rows added.

    Rows are counted in the table, before and after (parquet footers).
    """
    before = _rows(spark, root, tier, name)
    q = stream_table(spark, landing, name, schema, root, tier, checkpoint)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return _rows(spark, root, tier, name) - before


def _rows(spark: SparkSession, root: str, tier: str, name: str) -> int:
    return read_table(spark, root, tier, name).count() if table_exists(spark, root, tier, name) else 0
