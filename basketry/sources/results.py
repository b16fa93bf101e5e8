"""Results of a mart, kept until the mart changes.

A dashboard reads the same columns and filters of a mart again and again.  The
first reader computes them and writes them under the mart's version; the next
ones, in any process, scan the small result instead of the mart.  A rewritten
mart has a new version, so nothing stale is ever read, and the results of
versions that are gone are removed.

    <root>/_results/<mart>/<version>/<key>   a versioned table itself
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import versions as V
from .files import read_table, table_path, write_frame


def result(spark: SparkSession, root: str, mart: str, what: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``build(mart)``, computed once for each version of the mart and each ``what``.

    ``what`` must name all that ``build`` depends on besides the mart.  A mart
    without versions (files of another writer) is built from at every call.
    """
    version = V.current(spark, table_path(root, "analytics", mart))
    if version is None:
        return build(read_table(spark, root, "analytics", mart))
    folder = f"{root.rstrip('/')}/_results/{mart}"
    target = f"{folder}/{version.name}/{hashlib.sha256(what.encode()).hexdigest()[:32]}"
    done = V.current(spark, target)
    if done is None:
        write_frame(build(read_table(spark, root, "analytics", mart, version=version)), target)
        done = V.current(spark, target)
        _forget(spark, root, mart, folder)
    return spark.read.parquet(V.data_path(target, done))


def selection(spark: SparkSession, root: str, mart: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """Columns and rows (an SQL condition) of a mart, scanned once for each version of the mart."""

    def build(rows: DataFrame) -> DataFrame:
        rows = rows.where(where) if where else rows
        return rows.select(*columns) if columns else rows

    return result(spark, root, mart, repr(("selection", columns, where)), build)


def _forget(spark: SparkSession, root: str, mart: str, folder: str) -> None:
    """Remove results of versions that the mart no longer keeps."""
    kept = {v.name for v in V.versions(spark, table_path(root, "analytics", mart))}
    for name, _ in V._names(spark, folder):
        if name not in kept:
            V.delete(spark, f"{folder}/{name}")
