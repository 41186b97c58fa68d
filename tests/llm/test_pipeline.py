"""Every stage on its own input, and the whole."""

import zlib

from pyspark.sql import functions as F

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"


def test_stages_keep_their_contract(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.limit(1)).unionByName(spark.createDataFrame([(None, "!!!", None, None, 3), (-1, None, "en", "s", None)], docs.schema)).withColumn("row", F.lit(1))
    for (_, stage), least in zip(cp.STAGES[:-1], (200, 195, 150, 100)):
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns
        assert out.count() >= least
        docs = out
    tokens = cp.STAGES[-1][1](spark, docs, SF)
    assert tokens.count() == docs.count() and "ids_sha256" in tokens.columns


def test_language_stage_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert cp.identify_language(spark, docs, SF).count() == docs.count()


def test_near_duplicates_leave_one_of_a_group(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    copies = docs.where("doc_id % 10 = 3").withColumn("doc_id", F.col("doc_id") + 100_000)
    once = {r.doc_id for r in cp.drop_near_duplicates(spark, docs, SF).collect()}
    twice = {r.doc_id for r in cp.drop_near_duplicates(spark, docs.unionByName(copies), SF).collect()}
    assert once == twice


def test_run_is_repeatable(spark):
    a, b = (sorted(map(tuple, cp.run(spark, SF).collect())) for _ in range(2))
    assert a == b and a and zlib.crc32(b"")  == 0


def test_empty_documents(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
