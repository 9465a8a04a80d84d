"""The corpus pipeline: stages over documents, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and returns rows; all but the last return the
columns of documents.  ORACLE_SQL is None: language identification and SimHash have no
SQL form; tests hold the stages against brute force instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayer.llm import stages
from assayer.llm.common import saved

STAGES = [
    ("language", stages.language),
    ("near_duplicates", stages.near_duplicates),
    ("contamination", stages.contamination),
    ("secrets", stages.secret),
    ("tokens", stages.tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
