"""Quoted CSV with line breaks inside fields, read in parallel.

Spark reads a CSV whose quoted fields may hold line breaks as one split per
file, since a line break in the middle of a file may be either a record's end
or text.  Which one it is depends on one bit: whether the number of quotes
before it is even (a doubled quote inside a field adds two).  So:

1. Lines are read by byte ranges, as any text; one grouped sum counts the
   quotes of each range.
2. A running sum over the ranges of a file (a few rows) says in which state
   each range starts.
3. Every range then puts its own lines together to records, in one pass.  What
   it finds before its first record belongs to a record of an earlier range;
   its last record may go on in the next.  These pieces, at most two a range,
   are joined by file and range.

How a file is cut into ranges depends on the cores a session has, which may
change between 1 and 3 (executors come and go).  Ranges of step 3 that start
where one of step 1 did are right whatever their length; a range that starts
anywhere else raises, so no line is lost or misread.

Fields are RFC 4180: a quote inside a field is doubled, and such a field is
quoted.  A file with an odd number of quotes raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WHOLE, REST, START = 0, 1, 2
PIECE = "file string, block long, kind int, value string"


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block): lines of all files, by byte range (block: where the range starts), in order within a range."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _starts(lines: DataFrame) -> DataFrame:
    """(file, block, inside): whether a range starts inside a quoted field."""
    quotes = F.sum(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes")
    each = lines.groupBy("file", "block").agg(quotes).checkpoint()
    odd = each.groupBy("file").agg((F.sum("quotes") % 2).alias("odd")).where("odd = 1").select("file").limit(5).collect()
    if odd:
        raise ValueError(f"quotes are not balanced in {', '.join(r.file for r in odd)}")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return each.select("file", "block", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records and pieces of records of the ranges that a task reads, each range's lines in order."""
    at, inside, first = None, False, True
    held: list[str] = []  # lines of a record that is not finished
    kind = START
    out: list[tuple] = []

    def closed_range() -> None:
        if held:
            out.append((*at, kind, "\n".join(held)))
            held.clear()

    for b in batches:
        values, files = b.column(0).to_pylist(), b.column(1)
        blocks, starts = b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False)
        odd = np.asarray(pc.bit_wise_and(pc.count_substring(b.column(0), '"'), 1)).astype(bool)
        for i, line in enumerate(values):
            key = (files[i].as_py(), int(blocks[i])) if at is None or blocks[i] != at[1] or i == 0 or files[i] != files[i - 1] else at
            if key != at:
                if at is not None:
                    closed_range()
                at, inside = key, bool(starts[i])
                kind = REST if inside else START
                first = key[1] == 0
            if first:  # the header
                first = False
                continue
            held.append(line)
            inside ^= bool(odd[i])
            if not inside:
                out.append((*at, REST if kind == REST else WHOLE, "\n".join(held)))
                held.clear()
                kind = START
        if out:
            yield _batch(out)
            out.clear()
    if at is not None:
        closed_range()
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    file, block, kind, value = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(file), pa.array(block, pa.int64()), pa.array(kind, pa.int32()), pa.array(value)], ["file", "block", "kind", "value"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """(value, file): one row per record of all files but their headers, line breaks inside fields kept; blank lines are left out."""
    lines = lines_of(spark, path)
    # a broadcast join leaves the lines of a range together and in order; one short row a range
    placed = lines.join(F.broadcast(_starts(lines)), ["file", "block"], "left")
    other = F.raise_error(F.concat(F.lit("byte ranges changed while reading "), "file", F.lit(": read it again"))).cast("boolean")
    placed = placed.select("value", "file", "block", F.coalesce("inside", other).alias("inside"))
    pieces = placed.mapInArrow(_pieces, PIECE)
    whole = pieces.where(F.col("kind") == WHOLE).select("value", "file")
    split = pieces.where(F.col("kind") != WHOLE)
    # a start is followed by the rests of the next ranges, up to the next start
    order = Window.partitionBy("file").orderBy("block", "kind")
    numbered = split.withColumn("nth", F.sum((F.col("kind") == START).cast("int")).over(order))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("block", "kind", "value"))), lambda p: p["value"])
    joined = numbered.groupBy("file", "nth").agg(F.array_join(parts, "\n").alias("value")).select("value", "file")
    out = whole.unionByName(joined).select(F.regexp_replace("value", "\r$", "").alias("value"), "file")
    return out.where(F.trim("value") != "")


def read_quoted(spark: SparkSession, path: str, columns: list[str], strict: bool = True, corrupt: str | None = None) -> DataFrame:
    """String ``columns`` of all records; with ``strict`` a record of another number of fields fails.

    Otherwise ``corrupt`` (a column name) takes the text of such records, and file and block say where a record stood.
    """
    options = {"escape": '"', "mode": "FAILFAST" if strict else "PERMISSIVE"}
    schema = ", ".join(f"`{c}` string" for c in columns)
    if not corrupt:
        return records(spark, path).select(F.from_csv("value", schema, options).alias("r")).select("r.*")
    parsed = F.from_csv("value", f"{schema}, `{corrupt}` string", options | {"columnNameOfCorruptRecord": corrupt})
    return records(spark, path).select(parsed.alias("r"), "file", F.lit(None).cast("bigint").alias("block")).select("r.*", "file", "block")
