"""De-duplication: within files, against a table, and by fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of every key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def flag_repeats(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """``repeat``: an earlier row has the same key."""
    return df.withColumn("repeat", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)


def same_serial(rows: DataFrame, items: DataFrame, group: str = "group_id", serial: str = "serial_code") -> DataFrame:
    """(row_no, item_no): items of the group whose stored or recomputed serial is the row's (C4).

    Either key may match: both are listed and one equi-join is made.
    """
    keys = items.select(group, F.col("row_no").alias("item_no"), F.explode(F.array_distinct(F.array(C.normalize_serial(serial), C.sql_normalize_serial(serial)))).alias("key"))
    wanted = rows.select(group, "row_no", C.normalize_serial(serial).alias("key"))
    return wanted.join(keys, [group, "key"]).select("row_no", "item_no").distinct()


def without_known_assays(rows: DataFrame, items: DataFrame, group: str = "group_id") -> DataFrame:
    """Rows whose analysis the table does not hold; null equals null."""
    sig = lambda df: df.withColumn("_sig", C.import_signature(group, "serial_code", "weight_kg", "pt_ppm", "pd_ppm", "rh_ppm"))
    return sig(rows).join(sig(items).select("_sig").distinct(), "_sig", "left_anti").drop("_sig")


def spread_nulls(key, *others: str) -> Column:
    """The key, or for nulls a text that differs from row to row, so that these do not meet in one task."""
    return F.coalesce(F.col(key) if isinstance(key, str) else key, F.concat(F.lit("-"), F.xxhash64(*others).cast("string")))


def unique_fingerprints(items: DataFrame, order: list, fp: str = "assay_fingerprint") -> DataFrame:
    """The oldest row of a fingerprint keeps it; on the others it is blanked."""
    n = F.row_number().over(Window.partitionBy(spread_nulls(fp, *order)).orderBy(*order))
    return items.withColumn(fp, F.when(n == 1, F.col(fp)))


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys found more than once, nulls as empty."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys]
    return df.groupBy(*parts).agg(F.count("*").alias("n")).filter("n > 1")


def collisions(rows: DataFrame, items: DataFrame, fp: str = "new_fingerprint", held: str = "assay_fingerprint", key: str = "row_no") -> DataFrame:
    """``collides``: another row already holds the fingerprint this one would get."""
    # the empty text stands for null and meets no row: a condition on the fingerprint would have it computed twice
    holders = items.groupBy(F.coalesce(held, F.lit("")).alias("_held")).agg(F.min(key).alias("_low"), F.max(key).alias("_high"))
    other = (F.col("_low") != F.col(key)) | (F.col("_high") != F.col(key))
    asked = spread_nulls(F.nullif(F.col(fp), F.lit("")), key)
    return rows.join(holders, asked == F.col("_held"), "left").withColumn("collides", F.coalesce(other, F.lit(False))).drop("_low", "_high", "_held")
