"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task holds as Python objects at one time.
SLICE_BYTES = 4 << 20

#: The bytes 0x09-0x0D and 0x20 separate words; ``bytes.split()`` splits on just these.
SPACES = b"\t\n\x0b\x0c\r "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def two_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id and the text alone, under fixed names; other columns stay behind."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, in one folder of this application.

    Only a local master, as in tests, gets a folder of its own where the setting is missing; on a cluster
    that is an error, since executors do not share local folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = made.get() if made.isDefined() else None
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="assayer-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/assayer-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def released(spark: SparkSession) -> None:
    """Deletes all tables that ``saved`` has written in this application; results that read them are no longer of use."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark)).getParent()
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def saved(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    It cuts the lineage and survives lost executors: readers of the result never
    compute ``df`` again.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], text_col: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Pieces of the incoming batches of about ``size`` bytes, with their texts as UTF-8 bytes."""
    for batch in batches:
        at = 0
        text = batch.column(batch.schema.get_field_index(text_col))
        while at < batch.num_rows:
            n = max(1, min(batch.num_rows - at, 2048))
            piece = text.slice(at, n)
            if n > 1 and piece.nbytes > size:
                n = max(1, int(n * size / piece.nbytes))
                piece = text.slice(at, n)
            yield batch.slice(at, n), piece.cast(pa.binary()).to_pylist()
            at += n


def crc_mod(id_col: str, modulus: int):
    """crc32 of the id written as text, modulo ``modulus``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(modulus)


_held: dict = {}


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of the session get at most ``rows`` rows, as whole texts are large; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def unheld() -> None:
    """Frees the worker's large object, for tasks that need none themselves, and gives its memory back to the system."""
    if _held:
        _held.clear()
        gc.collect()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)


def held(key, make):
    """One large object for each worker process: another key's object goes first, so that
    workers that serve several operators do not add up their tables."""
    if key not in _held:
        unheld()
        _held[key] = make()
    return _held[key]
