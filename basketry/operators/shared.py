"""Frames with more than one reader, computed once.

Spark computes a frame anew for every job that reads it, and for every branch
of a plan that it cannot prove equal.  A frame that several steps read (a
sample for heavy keys, a dataset maximum, the steps themselves) is written as
parquet in the shared checkpoint folder and read back: later readers scan the
columns they need, the lineage is cut, and lost executors cost nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import ensure_checkpoint_dir


def written_once(df: DataFrame, name: str) -> DataFrame:
    """``df`` written in the shared folder and read back; one that is a plain scan of files already is returned as it is."""
    if is_plain_scan(df):
        return df
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_plain_scan(df: DataFrame) -> bool:
    """Whether a frame only reads files, without even a projection."""
    plan = df._jdf.queryExecution().analyzed()
    return plan.getClass().getSimpleName() == "LogicalRelation"
