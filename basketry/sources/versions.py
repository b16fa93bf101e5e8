"""Versions of a table: whole folders, put in place by creating one empty file.

    <table>/data-<id>/...            rows of one version (parquet)
    <table>/_commits/<number>-<id>   says that data-<id> is version <number>

A writer fills a new data folder and then creates the commit file.  That is one
atomic step on any Hadoop file system and any object store (nothing is renamed
and the file has no content that could be half there), so a writer that dies
anywhere leaves either the old version or the new one.  A reader takes the
highest commit and stays with its folder: a replacement does not pull files
from under it.  Of writers that commit the same number, the one with the
higher id is the version, for every reader.

``vacuum`` removes versions older than the last ``keep``, and folders that no
commit names once they are old enough not to be in the making.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

KEEP, ORPHAN_HOURS = 2, 24


@dataclass(frozen=True, order=True)
class Version:
    """One committed version of a table."""

    number: int
    id: str

    @property
    def name(self) -> str:
        return f"{self.number:012d}-{self.id}"


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of a path on any Hadoop file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(name, time of change in ms) of what lies in a folder; none if it is absent."""
    fs, p = hadoop(spark, folder)
    return [(st.getPath().getName(), st.getModificationTime()) for st in fs.listStatus(p)] if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = hadoop(spark, path)
    fs.delete(p, True)


def versions(spark: SparkSession, table: str) -> list[Version]:
    """All committed versions, oldest first."""
    parts = (name.split("-", 1) for name, _ in _names(spark, f"{table}/_commits") if not name.startswith("."))
    return sorted(Version(int(n), i) for n, i in parts)


def current(spark: SparkSession, table: str) -> Version | None:
    """The version that readers see now; None for a folder without versions."""
    return (versions(spark, table) or [None])[-1]


def data_path(table: str, version: Version) -> str:
    return f"{table}/data-{version.id}"


def new_id() -> str:
    return uuid.uuid4().hex[:16]


def commit(spark: SparkSession, table: str, id_: str) -> Version:
    """Make data-<id> the newest version; a folder that is not there (taken by a vacuum meanwhile) raises."""
    last = current(spark, table)
    version = Version(last.number + 1 if last else 1, id_)
    fs, data = hadoop(spark, data_path(table, version))
    if not fs.exists(data):
        raise FileNotFoundError(f"{data_path(table, version)} has no rows to commit")
    fs, p = hadoop(spark, f"{table}/_commits/{version.name}")
    fs.create(p, False).close()
    return version


def vacuum(spark: SparkSession, table: str, keep: int = KEEP, orphan_hours: float = ORPHAN_HOURS) -> None:
    """Remove all but the last ``keep`` versions, and old folders without a commit."""
    have = versions(spark, table)
    for old in have[:-keep]:
        # the commit goes first: a reader never finds one without its rows
        delete(spark, f"{table}/_commits/{old.name}")
        delete(spark, data_path(table, old))
    known, horizon = {f"data-{v.id}" for v in have}, (time.time() - orphan_hours * 3600) * 1000
    for name, changed in _names(spark, table):
        if name.startswith("data-") and name not in known and changed < horizon:
            delete(spark, f"{table}/{name}")
