"""Sources and sinks (A1-A10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..operators.search import file_order
from .arrays import array_records

_TEXTS = ["product_url", "brand_page_url", "brand_slug", "brand", "serial_code", "product_name", "thumbnail_url", "main_image_url", "card_price", "details", "detail", "description"]
FEED = T.StructType([*(T.StructField(n, T.StringType()) for n in _TEXTS), *(T.StructField(n, T.ArrayType(T.StringType())) for n in ("image_urls", "card_texts"))])
CELLS = "file string, sheet_idx int, sheet string, row int, col int, raw string"


def feed(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Feed records of JSON arrays, or one record a line; both are read in parallel, and a bad record is an error (A1)."""
    return spark.read.schema(FEED).option("mode", "FAILFAST").json(path) if lines else array_records(spark, path, FEED)


def as_lines(df: DataFrame, path: str) -> None:
    """Writes records one a line, for later parallel reads."""
    df.write.mode("overwrite").json(path)


def mapping(rows: DataFrame, body: str, order: list) -> DataFrame:
    """(key, url) of JSON objects: keys as slugs, blanks dropped, the last of equal keys in ``order`` wins (A2)."""
    pairs = rows.select(F.struct(*order).alias("_at"), F.posexplode(F.map_entries(F.from_json(body, "map<string,string>"))).alias("_p", "_e"))
    named = pairs.select("_at", "_p", C.slug("_e.key").alias("key"), C.blank_to_null("_e.value").alias("url")).filter("key IS NOT NULL AND url IS NOT NULL")
    return named.groupBy("key").agg(F.max_by("url", F.struct("_at", "_p")).alias("url"))


def cells(spark: SparkSession, path: str, first_row: int = 1, last_row: int | None = None, columns: int = 25) -> DataFrame:
    """Window of a long cell table; the conditions reach the Parquet scan (A3)."""
    df = spark.read.schema(CELLS).parquet(path)
    return window(df, first_row, last_row, columns)


def window(df: DataFrame, first_row: int, last_row: int | None, columns: int, row: str = "row", col: str = "col") -> DataFrame:
    out = df.filter((F.col(row) >= first_row) & (F.col(col) <= columns))
    return out if last_row is None else out.filter(F.col(row) <= last_row)


def workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Workbook files below a folder, in natural order, without lock files (A4)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return file_order(files)


def _numbers(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.when(C.trim(name).rlike(r"^\d+$"), C.trim(name).try_cast("long")).alias(name)).filter(F.col(name).isNotNull()).distinct()


def report_media(report: DataFrame) -> DataFrame:
    """Distinct numeric media ids of a report (A5)."""
    return _numbers(report, "media_id")


def report_items(report: DataFrame, media: DataFrame) -> DataFrame:
    """Distinct items of a report: its model ids if any row has one, else those of its media."""
    if "model_id" in report.columns:
        own = report.select(C.blank_to_null("model_id").alias("item_id")).filter("item_id IS NOT NULL").distinct()
        if not own.isEmpty():
            return own
    return report_media(report).join(media.select("media_id", "item_id"), "media_id").select("item_id").distinct()


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def write_audit(folder: str, **tables: DataFrame) -> None:
    """One CSV folder with a header for each table; lists are joined by a bar."""
    for name, df in tables.items():
        flat = [F.array_join(F.array_sort(c), "|").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
        df.select(*flat).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def write_summary(df: DataFrame, path: str) -> None:
    """A summary or manifest as JSON."""
    df.write.mode("overwrite").json(path)


def upserted(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Matched rows take the changes that are not null, unmatched ones are added, none twice.

    Write the result to a new path: a dry run (A10) just leaves that out.
    """
    own = [c for c in table.columns if c != key]
    new = changes.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in own if c in changes.columns))
    return table.join(new, key, "full").select(key, *(F.coalesce(f"_{c}", c).alias(c) if c in changes.columns else F.col(c) for c in own))
