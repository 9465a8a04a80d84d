"""The stages on the small tables: columns, effects, and clean rows kept."""

import corpus_pipeline
from assayer.llm import secrets


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        after = stage(spark, docs, sf_dir)
        if name != "tokens":
            assert after.columns == columns
            assert 0.7 * before <= after.count() <= before
            again = after.count()
            assert again == after.select("doc_id").distinct().count()
        if name == "secrets":
            assert after.count() == before
            left = secrets.scan(after).selectExpr("sum(size(_secret_base)) AS n").first().n
            assert left == 0
        docs = after
    assert docs.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]


def test_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
