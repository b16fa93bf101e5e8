"""Spark session defaults for the engine.

Everything the marts need from the session is set here once: ANSI mode
(bad casts and division by zero fail, as they do in a SQL warehouse), a UTC
session clock, adaptive execution with skew-join splitting, and a shared
checkpoint folder.  On a cluster the checkpoint folder comes from the
cluster's own ``spark.checkpoint.dir``; we only pick one when it is unset
(tests, local runs).
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

# Settings that decide results or plan shape; applied to every session we build.
SQL_DEFAULTS: dict[str, str] = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # parquet timestamps without zone stay TIMESTAMP_NTZ, like the warehouse type
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
}


def build_session(
    master: str | None = None,
    app_name: str = "basketry",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the engine defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for k, v in SQL_DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    apply_sql_defaults(spark)
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def apply_sql_defaults(spark: SparkSession) -> None:
    """Set the SQL settings on a session of our own; one that cannot be set fails."""
    for k, v in SQL_DEFAULTS.items():
        spark.conf.set(k, v)


def own_session(spark: SparkSession) -> SparkSession:
    """A session beside the caller's, on the same context, with its settings and our defaults.

    The caller's settings stay as they are.
    """
    own = spark.newSession()
    given = own.conf.getAll  # from the context's configuration
    for k, v in spark.conf.getAll.items():
        if given.get(k) != v and (spark.conf.isModifiable(k) or not k.startswith("spark.")):
            own.conf.set(k, v)
    apply_sql_defaults(own)
    return own


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the cluster names, if any."""
    return spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's checkpoint folder; pick a scratch folder only when none is set.

    ``SparkContext.setCheckpointDir`` appends a unique subfolder, so it is called
    at most once per context.  A scratch folder is only right in local mode
    (tests, bench); on a cluster the setting points at shared storage.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not (sc.master or "").startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set: on a cluster it must name a shared folder "
                "(executors and the driver read and write it)"
            )
        d = tempfile.mkdtemp(prefix="basketry-ckpt-", dir=os.environ.get("BASKETRY_SCRATCH", "/tmp"))
        atexit.register(shutil.rmtree, d, ignore_errors=True)  # a folder of our own making
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in executor Python workers (pandas UDFs).

    Zips the package once per driver process and registers it with
    ``addPyFile``, which distributes it to every executor.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="basketry-pyfiles-")
    archive = shutil.make_archive(
        os.path.join(out, "basketry"), "zip", root_dir=os.path.dirname(pkg_dir), base_dir=os.path.basename(pkg_dir)
    )
    sc.addPyFile(archive)
    _SHIPPED.add(key)
