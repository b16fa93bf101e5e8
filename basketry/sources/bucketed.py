"""Tables dealt into buckets by a key, so that joins on it need no shuffle.

A bucketed version of a table is written like any other (``versions.py``), with
one file a bucket; a marker beside the files names key and number.  A reader
registers the files under a name of the version's own, which tells Spark that
they are hashed and sorted by the key: joins and aggregates on it, with tables
of as many buckets, start without an exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import versions as V
from .files import table_path

MARK = "_buckets-"


def write_bucketed(df: DataFrame, root: str, tier: str, name: str, by: str, buckets: int, keep: int = V.KEEP) -> V.Version:
    """Full-replace write of a table as ``buckets`` files hashed and sorted by ``by``."""
    spark, id_, table = df.sparkSession, V.new_id(), table_path(root, tier, name)
    data, alias = f"{table}/data-{id_}", f"basketry_{id_}"
    # dealt as the buckets are: each task writes one file
    rows = df.repartition(buckets, F.col(by))
    try:
        rows.write.format("parquet").bucketBy(buckets, by).sortBy(by).option("path", data).saveAsTable(alias)
        fs, mark = V.hadoop(spark, f"{data}/{MARK}{buckets}-{by}")
        fs.create(mark, False).close()
    except Exception:
        V.delete(spark, data)
        raise
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {alias}")  # the name only: the files are the table's
    version = V.commit(spark, table, id_)
    V.vacuum(spark, table, keep)
    return version


def read_bucketed(spark: SparkSession, root: str, tier: str, name: str, version: V.Version | None = None) -> DataFrame:
    """A table written by ``write_bucketed``, with its buckets known to the planner; any other table raises."""
    table = table_path(root, tier, name)
    version = version or V.current(spark, table)
    marks = [n for n, _ in V._names(spark, V.data_path(table, version))] if version else []
    mark = next((n for n in marks if n.startswith(MARK)), None)
    if mark is None:
        raise ValueError(f"{tier}.{name} has no buckets")
    buckets, by = mark.removeprefix(MARK).split("-", 1)
    data = V.data_path(table, version)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(data).schema.fields)
    alias = f"basketry_{version.id}"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {alias} ({columns}) USING parquet CLUSTERED BY (`{by}`) SORTED BY (`{by}`) INTO {buckets} BUCKETS LOCATION '{data}'")
    return spark.table(alias)
