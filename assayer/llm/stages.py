"""Stages of the corpus pipeline: each takes and returns rows with the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, decontaminate, langid, secrets, simhash
from .common import small_batches, table

#: A text is rejected if its best language has less than this share of the posterior.
LEAST_LANGUAGE_SCORE = 0.5


def language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language (null, no letter) or with an unsure one; repeated rows are judged alike."""
    small_batches(spark)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    fitted = langid.fit(docs.filter(~held_out))
    return langid.kept(docs, fitted, LEAST_LANGUAGE_SCORE)


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of every group of near copies (5-word shingles, similarity 0.8).

    Null and empty texts are one group.  Rows with a null id stay, and so do all rows of a kept id.
    """
    small_batches(spark)
    first = simhash.near_groups(docs).filter("least = component_id").select(F.col("least").alias("doc_id")).distinct()
    return docs.join(first, "doc_id", "left_semi").unionByName(docs.filter("doc_id IS NULL"))


def contamination(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words at least 5 % stand in benchmark windows.

    Null and empty texts have no words and stay; each of repeated rows is judged for itself.
    """
    small_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces reported secrets by a mark; n_chars, if there is such a column, follows.

    Null and empty texts stay as they are; repeated rows change alike; all rows are kept.
    """
    small_batches(spark)
    scanned = secrets.measured(secrets.saved(secrets.scan(docs)))
    out = secrets.redacted(secrets.found(scanned, secrets.threshold(scanned)))
    new = {"n_chars": F.when(F.size("_secrets") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {}
    return out.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))


def tokens(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digest of the decoded text.

    A null text counts as empty; repeated rows stay; other columns are dropped.
    """
    small_batches(spark)
    return bpe.round_trip(docs, bpe.default_vocabulary()).select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
