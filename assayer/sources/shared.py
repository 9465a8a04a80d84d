"""Tables written once to the folder that all executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local master gets one of its own where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="assayer-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/assayer-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def saved(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` written as Parquet and read back: it is computed once, and lost executors cost no recomputation."""
    path = shared_folder(df.sparkSession)
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    schema = df.schema
    return df.sparkSession.read.schema(schema).parquet(path).select(*schema.names)
