"""Ingest by header, free text, atomic replace, absent tables, restart-safe streaming."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from basketry.__main__ import build_and_check
from basketry.schemas import RAW_SCHEMAS, SELLERS
from basketry.sources import files as FS
from basketry.sources import fixtures as FX
from basketry.streaming.ingest import ingest_available

SF = "/root/testdata/sf0.001"


def test_columns_are_matched_by_header(spark, tmp_path):
    (tmp_path / "customers.csv").write_text(
        "customer_state,Customer City,extra,customer_unique_id,customer_id,customer_zip_code_prefix\nSP,sao paulo,x,u1,c1,01000\n"
    )
    got = FS.ingest_dir(spark, str(tmp_path))["customers"]
    assert got.columns == RAW_SCHEMAS["customers"].fieldNames()
    assert tuple(got.first()) == ("c1", "u1", "01000", "sao paulo", "SP")


def test_a_missing_column_raises(spark, tmp_path):
    (tmp_path / "sellers.csv").write_text("seller_id,seller_city,seller_state\ns1,rio,RJ\n")
    with pytest.raises(ValueError, match="seller_zip_code_prefix"):
        FS.ingest_dir(spark, str(tmp_path))


def test_quoted_newlines_and_doubled_quotes(spark, tmp_path):
    (tmp_path / "order_reviews.csv").write_text(
        "review_id,order_id,review_score,review_comment_title,review_comment_message,review_creation_date,review_answer_timestamp\n"
        'r1,o1,5,,"first line\nsecond, ""quoted"" line",2018-01-01,2018-01-02\nr2,o2,1,bad,plain,2018-01-01,2018-01-02\n'
    )
    (tmp_path / "sellers.csv").write_text('seller_id,seller_zip_code_prefix,seller_city,seller_state\ns1,01,"the ""old"" town, north",RJ\n')
    tables = FS.ingest_dir(spark, str(tmp_path))
    rows = {r.review_id: r for r in tables["order_reviews"].collect()}
    assert rows["r1"].review_comment_message == 'first line\nsecond, "quoted" line' and rows["r1"].review_score == 5
    assert rows["r2"].review_comment_message == "plain" and len(rows) == 2
    assert tables["sellers"].first().seller_city == 'the "old" town, north'


def test_plain_tables_stay_splittable(spark, tmp_path):
    """Only free text is read whole file by file."""
    n = 200_000
    text = "seller_id,seller_zip_code_prefix,seller_city,seller_state\n" + "".join(f"s{i},01000,city,SP\n" for i in range(n))
    (tmp_path / "sellers.csv").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(512 * 1024))
    try:
        df = FS.ingest_dir(spark, str(tmp_path))["sellers"]
        assert df.rdd.getNumPartitions() > 1 and df.count() == n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    root = str(tmp_path / "wh")
    FS.write_table(spark.range(10), root, "raw", "t")
    bad = spark.range(100).select(F.when(F.col("id") < 99, F.col("id")).otherwise(F.raise_error(F.lit("broken"))).alias("id"))
    with pytest.raises(Exception, match="broken"):
        FS.write_table(bad, root, "raw", "t")
    assert FS.read_table(spark, root, "raw", "t").count() == 10
    assert FS.write_table(spark.range(4), root, "raw", "t") == 4
    assert os.listdir(os.path.join(root, "raw")) == ["t"]


def test_a_table_can_be_replaced_by_what_was_read_from_it(spark, tmp_path):
    root = str(tmp_path / "wh")
    FS.write_table(spark.range(10), root, "raw", "t")
    FS.write_table(FS.read_table(spark, root, "raw", "t").where("id < 5"), root, "raw", "t")
    assert FS.read_table(spark, root, "raw", "t").count() == 5


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_models_of_absent_tables_are_left_out(spark, tmp_path, capsys):
    root = str(tmp_path / "wh")
    raw = FX.raw_tables(spark, SF)
    for name in ("orders", "order_items"):
        FS.write_table(raw[name], root, "raw", name)
    assert build_and_check(spark, root)
    out = capsys.readouterr().out
    assert "SKIP dim_customer: no raw table customers" in out
    assert sorted(os.listdir(os.path.join(root, "analytics"))) == ["fct_orders", "monthly_revenue"]
    assert not build_and_check(spark, str(tmp_path / "empty"))


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_all_nine_tables_have_adapters_with_the_declared_columns(spark):
    raw = FX.raw_tables(spark, SF)
    assert set(raw) == set(RAW_SCHEMAS)
    for name, schema in RAW_SCHEMAS.items():
        assert raw[name].columns == schema.fieldNames()
    # payments add up to the order's price
    paid = raw["order_payments"].groupBy("order_id").agg(F.sum("payment_value").alias("v"))
    want = spark.read.parquet(f"{SF}/orders.parquet").select(F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").cast("decimal(18,2)").alias("t"))
    assert paid.join(want, "order_id").where("v <> t").count() == 0


HEAD = "seller_id,seller_zip_code_prefix,seller_city,seller_state\n"


def test_a_second_process_goes_on_where_the_first_stopped(spark, tmp_path):
    landing, root = tmp_path / "landing", str(tmp_path / "wh")
    landing.mkdir()
    (landing / "a.csv").write_text(HEAD + "s1,01000,a,SP\n")
    code = (
        "from basketry.session import build_session\nfrom basketry.schemas import SELLERS\n"
        "from basketry.streaming.ingest import ingest_available\n"
        f"s = build_session('local[2]')\nprint('ROWS', ingest_available(s, {str(landing)!r}, 'sellers', SELLERS, {root!r}))\ns.stop()\n"
    )
    env = {**os.environ, "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    env.pop("PYSPARK_GATEWAY_PORT", None)
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 1" in done.stdout, done.stderr[-2000:]
    (landing / "b.csv").write_text(HEAD + "s2,02000,b,RJ\ns3,03000,c,MG\n")
    assert ingest_available(spark, str(landing), "sellers", SELLERS, root) == 2
    assert ingest_available(spark, str(landing), "sellers", SELLERS, root) == 0
    assert sorted(r.seller_id for r in FS.read_table(spark, root, "raw", "sellers").collect()) == ["s1", "s2", "s3"]


def test_a_stream_file_with_another_header_fails(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "a.csv").write_text("seller_id,seller_city,seller_zip_code_prefix,seller_state\ns1,a,01000,SP\n")
    with pytest.raises(Exception):
        ingest_available(spark, str(landing), "sellers", SELLERS, str(tmp_path / "wh"))
