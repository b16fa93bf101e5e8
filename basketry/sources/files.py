"""File sources and sinks: CSV ingest of a directory, tiered parquet tables.

Ingest lists the directory on the driver (names only) and reads every file
by its header: columns are matched to the declared schema by normalised name,
whatever their order, and cast.  Executors read the splits in parallel, those of
tables with free text (line breaks in quoted fields, ``quoted.py``) as well.
Tables are written as versions of ``<root>/<tier>/<name>`` (``versions.py``):
readers see a new one when its write has succeeded.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import FREE_TEXT_TABLES, RAW_SCHEMAS
from . import versions as V
from .quoted import read_quoted


def normalize_name(name: str) -> str:
    """lower-case; spaces and dots become underscores."""
    return name.lower().replace(" ", "_").replace(".", "_")


def normalize_columns(df: DataFrame) -> DataFrame:
    """Rename every column to its normalised form (one projection, no data movement)."""
    return df.toDF(*[normalize_name(c) for c in df.columns])


def table_name_for(file_name: str, prefix: str = "") -> str:
    """File name → table name: drop the dataset prefix, '_dataset.csv' and '.csv'."""
    n = file_name
    if prefix:
        n = n.replace(prefix, "")
    return n.replace("_dataset.csv", "").replace(".csv", "")


def _list_csv(spark: SparkSession, path: str) -> list[str]:
    """File names ending in .csv directly under ``path`` (any Hadoop file system)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath) or not fs.getFileStatus(hpath).isDirectory():
        return []
    # a folder named *.csv is a CSV written by a distributed writer (part files inside)
    names = [st.getPath().getName() for st in fs.listStatus(hpath)]
    return sorted(n for n in names if n.endswith(".csv"))


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | None, strict: bool = True, free_text: bool = False
) -> DataFrame:
    """One CSV file or folder with header, by column name; malformed rows and values fail.

    Names are normalised before they are matched; a declared column that the
    file lacks raises, columns that the schema lacks are left out.  With
    ``free_text`` quoted fields may hold line breaks.
    ``strict=False`` turns malformed values into NULL.
    """
    r = spark.read.option("header", True).option("inferSchema", False).option("enforceSchema", False)
    r = r.option("mode", "FAILFAST" if strict else "PERMISSIVE").option("escape", '"')
    df = r.csv(path)
    df = normalize_columns(read_quoted(spark, path, df.columns, strict) if free_text else df)
    if schema is None:
        return df
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)} (found: {', '.join(df.columns)})")
    return df.select(*[(F.col(f.name).cast(f.dataType) if strict else F.col(f.name).try_cast(f.dataType)).alias(f.name) for f in schema.fields])


def ingest_dir(
    spark: SparkSession,
    path: str,
    schemas: dict[str, T.StructType] | None = None,
    prefix: str = "",
) -> dict[str, DataFrame]:
    """Read every ``*.csv`` in ``path`` as one table per file.

    A missing directory or an empty one gives no tables (and a message).
    Tables with a declared schema are read with it; others as strings.
    """
    schemas = RAW_SCHEMAS if schemas is None else schemas
    files = _list_csv(spark, path)
    if not files:
        print(f"no CSV files found in {path}")
        return {}
    out: dict[str, DataFrame] = {}
    for f in files:
        name = table_name_for(f, prefix)
        out[name] = read_csv(spark, os.path.join(path, f), schemas.get(name), free_text=name in FREE_TEXT_TABLES)
    return out


def table_path(root: str, tier: str, name: str) -> str:
    """Folder of a table: ``<root>/<tier>/<name>``."""
    return f"{root.rstrip('/')}/{tier}/{name}"


def table_exists(spark: SparkSession, root: str, tier: str, name: str) -> bool:
    """Whether the table has a version, or is a folder that another writer (a stream) fills."""
    path = table_path(root, tier, name)
    if V.current(spark, path) is not None:
        return True
    fs, p = V.hadoop(spark, path)
    return bool(fs.exists(p)) and any(not n.startswith(("_", ".", "data-")) for n, _ in V._names(spark, path))


def write_frame(df: DataFrame, table: str, partition_by: list[str] | None = None, keep: int = V.KEEP) -> V.Version:
    """Write ``df`` as the newest version of the table in folder ``table``; a write that fails leaves the old one."""
    spark, id_ = df.sparkSession, V.new_id()
    new = f"{table}/data-{id_}"
    w = df.write.mode("error")
    if partition_by:
        w = w.partitionBy(*partition_by)
    try:
        w.parquet(new)
    except Exception:
        V.delete(spark, new)
        raise
    version = V.commit(spark, table, id_)
    V.vacuum(spark, table, keep)
    return version


def write_table(
    df: DataFrame,
    root: str,
    tier: str,
    name: str,
    observe: bool = True,
    partition_by: list[str] | None = None,
    keep: int = V.KEEP,
) -> int | None:
    """Full-replace write of one table as parquet; returns the written row count.

    The rows become a new version of the table (``versions.py``): readers see
    either the old rows or all new ones, whenever the writer dies, and those
    that hold the old version keep it until ``keep`` newer ones exist.  The
    count is taken with an ``Observation`` during the write, so the table is
    not scanned a second time.  ``partition_by`` writes one folder per value, so
    filters on those columns prune whole folders at read time.
    """
    if observe:
        obs = Observation(f"rows_{tier}_{name}")
        df = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    write_frame(df, table_path(root, tier, name), partition_by, keep)
    return int(obs.get["rows"]) if observe else None


def read_table(
    spark: SparkSession,
    root: str,
    tier: str,
    name: str,
    schema: T.StructType | None = None,
    version: V.Version | None = None,
) -> DataFrame:
    """Read a table as of now, or a given version; a schema keeps partition columns at their written type.

    The frame stays with the version it was opened at.  A folder without
    versions is read as it is.
    """
    r = spark.read.schema(schema) if schema is not None else spark.read
    path = table_path(root, tier, name)
    version = version or V.current(spark, path)
    if version is None:
        return r.parquet(path)
    data = V.data_path(path, version)
    if not _has_parts(spark, data):
        return r.parquet(data)
    rows = r.parquet(data).where(F.col(PART) == GOOD)
    return rows.select(*[c for c in rows.columns if c not in (PART, *REJECT_COLUMNS)])


#: Folder column that parts good from rejected rows, and what a checked load adds to a row.
PART, GOOD, BAD = "load_part", "good", "rejected"
REJECT_COLUMNS = ("load_file", "load_block", "load_rejects")


def _has_parts(spark: SparkSession, data: str) -> bool:
    return any(name.startswith(f"{PART}=") for name, _ in V._names(spark, data))


def load_checked(
    spark: SparkSession, path: str, schema: T.StructType, root: str, tier: str, name: str, free_text: bool = False
) -> tuple[int, int]:
    """Load one CSV file or folder as a new version of a table and set malformed rows aside; (good, rejected) rows.

    One pass writes both: rows whose values all convert, which ``read_table``
    returns, and the others, which ``rejected_rows`` tells value by value.  A
    value is malformed if it is not null and does not convert to its declared
    type; a row, if it has another number of fields than the header.
    """
    corrupt = "load_corrupt"
    r = spark.read.option("header", True).option("escape", '"')
    names = [normalize_name(c) for c in r.csv(path).columns]
    missing = [f.name for f in schema.fields if f.name not in names]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)} (found: {', '.join(names)})")
    if free_text:
        raw = read_quoted(spark, path, names, False, corrupt).withColumnsRenamed({"file": "load_file", "block": "load_block"})
    else:
        text = T.StructType([T.StructField(c, T.StringType()) for c in [*names, corrupt]])
        # all columns are parsed, wanted or not: the number of fields counts
        raw = r.schema(text).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt).option("columnPruning", False).csv(path)
        raw = raw.select("*", F.col("_metadata.file_path").alias("load_file"), F.col("_metadata.file_block_start").alias("load_block"))
    told = lambda column, value: F.struct(column.cast("string").alias("column"), value.alias("value"))
    bad = [F.when(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull(), told(F.lit(f.name), F.col(f.name))) for f in schema.fields]
    row = F.when(F.col(corrupt).isNotNull(), F.array(told(F.lit(None), F.col(corrupt)))).otherwise(F.array_compact(F.array(*bad)))
    rows = raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields], "load_file", "load_block", row.alias("load_rejects"))
    rows = rows.withColumn(PART, F.when(F.size("load_rejects") == 0, GOOD).otherwise(BAD))
    seen = Observation(f"checked_{tier}_{name}")
    is_bad = F.col(PART) == BAD
    rows = rows.observe(seen, F.count_if(~is_bad).alias("good"), F.count_if(is_bad).alias("bad"))
    write_frame(rows, table_path(root, tier, name), [PART])
    return int(seen.get["good"]), int(seen.get["bad"])


def rejected_rows(spark: SparkSession, root: str, tier: str, name: str) -> DataFrame:
    """(file, block, column, value): malformed values of the table's last checked load; a row of a wrong number of fields has a null column and its whole text."""
    path = table_path(root, tier, name)
    version = V.current(spark, path)
    if version is None or not _has_parts(spark, V.data_path(path, version)):
        return spark.createDataFrame([], "file string, block bigint, column string, value string")
    rows = spark.read.parquet(V.data_path(path, version)).where(F.col(PART) == BAD)
    return rows.select(F.col("load_file").alias("file"), F.col("load_block").alias("block"), F.inline("load_rejects"))


def read_mart(
    spark: SparkSession, root: str, name: str, columns: list[str] | None = None, schema: T.StructType | None = None
) -> DataFrame:
    """Scan a mart; a column list prunes the parquet read (instead of ``SELECT *``)."""
    df = read_table(spark, root, "analytics", name, schema)
    return df.select(*columns) if columns else df


def load_tables(tables: dict[str, DataFrame], root: str, tier: str = "raw") -> DataFrame:
    """Write every table (overwrite) and return the load report (table_name, row_count)."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(name, write_table(df, root, tier, name)) for name, df in tables.items()]
    return spark.createDataFrame(rows, "table_name string, row_count bigint")
