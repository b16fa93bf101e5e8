from __future__ import annotations

from basketry.schemas import SELLERS
from basketry.streaming.ingest import ingest_available


def test_incremental_ingest_is_exactly_once(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    root = str(tmp_path / "wh")
    ckpt = str(tmp_path / "ckpt")
    (landing / "sellers_1.csv").write_text("seller_id,seller_zip_code_prefix,seller_city,seller_state\ns1,01000,a,SP\ns2,02000,b,RJ\n")
    assert ingest_available(spark, str(landing), "sellers", SELLERS, root, checkpoint=ckpt) == 2
    # a rerun with no new files adds nothing
    assert ingest_available(spark, str(landing), "sellers", SELLERS, root, checkpoint=ckpt) == 0
    (landing / "sellers_2.csv").write_text("seller_id,seller_zip_code_prefix,seller_city,seller_state\ns3,03000,c,MG\n")
    assert ingest_available(spark, str(landing), "sellers", SELLERS, root, checkpoint=ckpt) == 1
    got = spark.read.parquet(f"{root}/raw/sellers")
    assert sorted(r.seller_id for r in got.collect()) == ["s1", "s2", "s3"]
    assert got.where("seller_id = 's1'").first().seller_zip_code_prefix == "01000"
