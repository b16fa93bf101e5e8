"""Quoted CSV cut into byte ranges anywhere, against a sequential reader."""

from __future__ import annotations

import csv
import io
import random

import pytest

from basketry.schemas import RAW_SCHEMAS
from basketry.sources import files as FS
from basketry.sources.quoted import read_quoted, records


@pytest.fixture()
def short_ranges(spark):
    """Byte ranges of a few dozen bytes: most records are cut."""
    keys = {"spark.sql.files.maxPartitionBytes": "40", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def text_of(rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


def field(r):
    return "".join(r.choices(["a", "word", " ", ",", '"', "\n", "\n\n", "é", '""', "x,y"], k=r.randint(0, 6)))


def table(n, seed):
    r = random.Random(seed)
    rows = [["id", "one", "two"]]
    for i in range(n):
        long = "\n".join("line" for _ in range(r.randint(20, 60))) if i % 17 == 5 else field(r)
        rows.append([str(i), long, field(r)])
    return rows


def expected(rows):
    # empty fields are null, and a field is trimmed by neither reader
    return sorted((tuple(v if v != "" else None for v in r) for r in rows[1:]), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [0, 1])
def test_any_cut_gives_the_records_of_a_sequential_reader(spark, tmp_path, short_ranges, seed):
    rows = table(60, seed)
    (tmp_path / "t.csv").write_text(text_of(rows), newline="")
    df = read_quoted(spark, str(tmp_path / "t.csv"), rows[0])
    assert records(spark, str(tmp_path / "t.csv")).rdd.getNumPartitions() > 10
    assert got(df) == expected(rows)


@pytest.mark.parametrize("later", [160, 320, 20])
def test_ranges_that_change_between_the_passes(spark, tmp_path, short_ranges, later):
    """Longer ranges at the same places read the same records, any others raise: never fewer rows."""
    rows = table(40, 3)
    (tmp_path / "t.csv").write_text(text_of(rows), newline="")
    df = read_quoted(spark, str(tmp_path / "t.csv"), rows[0])
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(later))
    if later > 40:
        assert got(df) == expected(rows)
    else:
        with pytest.raises(Exception, match="byte ranges changed"):
            df.collect()


def test_windows_line_ends_and_several_files(spark, tmp_path, short_ranges):
    folder = tmp_path / "t.csv"
    folder.mkdir()
    a, b = table(25, 3), table(30, 4)
    (folder / "a.csv").write_text(text_of(a, "\r\n"), newline="")
    (folder / "b.csv").write_text(text_of(b), newline="")
    assert got(read_quoted(spark, str(folder), a[0])) == sorted(expected(a) + expected(b), key=str)


def test_no_final_line_end_blank_lines_and_an_empty_table(spark, tmp_path, short_ranges):
    (tmp_path / "t.csv").write_text('id,one\n1,"a\nb"\n\n2,"c\n\n"')
    assert got(read_quoted(spark, str(tmp_path / "t.csv"), ["id", "one"])) == [("1", "a\nb"), ("2", "c\n\n")]
    (tmp_path / "e.csv").write_text("id,one\n")
    assert got(read_quoted(spark, str(tmp_path / "e.csv"), ["id", "one"])) == []


def test_unbalanced_quotes_raise(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,one\n1,"a\n')
    with pytest.raises(ValueError, match="quotes are not balanced"):
        read_quoted(spark, str(tmp_path / "t.csv"), ["id", "one"])


def test_one_reviews_file_is_read_by_many_tasks(spark, tmp_path):
    schema = RAW_SCHEMAS["order_reviews"]
    n = 20_000
    rows = [schema.fieldNames()] + [[f"r{i}", f"o{i}", str(i % 5 + 1), None, f'said "{i}",\nand left', "2018-01-01", "2018-01-02"] for i in range(n)]
    (tmp_path / "order_reviews.csv").write_text(text_of(rows))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(256 * 1024))
    try:
        df = FS.ingest_dir(spark, str(tmp_path))["order_reviews"]
        assert df.rdd.getNumPartitions() > 4
        assert df.where("review_comment_message = concat('said \"', substr(review_id, 2), '\",\nand left') and review_score = int(substr(review_id, 2)) % 5 + 1").count() == n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
