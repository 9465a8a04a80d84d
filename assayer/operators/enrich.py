"""Filling and repairing existing items from rows, without a loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .dedupe import collisions, spread_nulls


def _state(field: str, w, weight: bool) -> Column:
    """A field's value after the rows of the window: its first value, an implausible weight replaced by the first sound one."""
    first = F.first(field, ignorenulls=True).over(w)
    if not weight:
        return first
    sound = F.first(F.when((F.col(field) > 0) & (F.col(field) <= 50), F.col(field)), ignorenulls=True).over(w)
    return F.when(first > 50, F.coalesce(sound, first)).otherwise(first)


def progressive_fill(items: DataFrame, rows: DataFrame, keys: list[str], order: list[str], fields: list[str], weight: str = "weight_kg") -> DataFrame:
    """Rows with their outcome: created, updated, noop or ambiguous, and the state after each (none if ambiguous).

    The existing item stands before the rows of its key.  A row updates if any field's
    state differs with it from without it.
    """
    count = items.groupBy(*keys).agg(F.count("*").alias("_items"))
    both = items.select(*keys, *fields, F.lit(0).alias("_kind"), *(F.lit(None).cast(dict(rows.dtypes)[o]).alias(o) for o in order)).unionByName(rows.select(*keys, *fields, F.lit(1).alias("_kind"), *order))
    w = Window.partitionBy(*keys).orderBy("_kind", *order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    changed = F.lit(False)
    for f in fields:
        changed = changed | ~_state(f, upto, f == weight).eqNullSafe(_state(f, before, f == weight))
    n = F.row_number().over(w)
    out = both.withColumn("_n", n).withColumn("_changed", changed)
    for f in fields:
        out = out.withColumn(f"after_{f}", _state(f, upto, f == weight))
    out = out.filter("_kind = 1").join(count, keys, "left")
    outcome = F.when(F.col("_items") > 1, "ambiguous").when(F.col("_n") == 1, "created").when(F.col("_changed"), "updated").otherwise("noop")
    return out.select(*keys, *order, outcome.alias("outcome"), *(F.when(outcome != "ambiguous", F.col(f"after_{f}")).alias(f"after_{f}") for f in fields))


def repaired_units(items: DataFrame, chosen: Column, factor: float = 1000.0) -> DataFrame:
    """Assays of the chosen rows times ``factor``; a fingerprint that another row holds, or that an earlier row gets, is blanked."""
    fp = lambda *a: C.fingerprint("group_id", "serial_code", *a)
    base = items.withColumn("assay_fingerprint", fp("weight_kg", "pt_ppm", "pd_ppm", "rh_ppm"))
    batch, rest = base.filter(chosen), base.filter(~F.coalesce(chosen, F.lit(False)))
    for m in ("pt_ppm", "pd_ppm", "rh_ppm"):
        batch = batch.withColumn(m, F.col(m) * factor)
    return _refingerprinted(batch, rest)


def repaired_weights(items: DataFrame) -> DataFrame:
    """Weights over 50 as grams, with new fingerprints (P10)."""
    base = items.withColumn("assay_fingerprint", C.fingerprint("group_id", "serial_code", "weight_kg", "pt_ppm", "pd_ppm", "rh_ppm"))
    heavy = F.coalesce(F.col("weight_kg") > 50, F.lit(False))
    return _refingerprinted(base.filter(heavy).withColumn("weight_kg", C.weight_in_kg("weight_kg")), base.filter(~heavy))


def _refingerprinted(batch: DataFrame, rest: DataFrame) -> DataFrame:
    new = batch.withColumn("new_fingerprint", C.fingerprint("group_id", "serial_code", "weight_kg", "pt_ppm", "pd_ppm", "rh_ppm"))
    n = F.row_number().over(Window.partitionBy(spread_nulls("new_fingerprint", "row_no")).orderBy("row_no"))
    flagged = collisions(new.withColumn("_n", n), rest)
    return flagged.withColumn("assay_fingerprint", F.when(~F.col("collides") & (F.col("_n") == 1), F.col("new_fingerprint"))).drop("_n", "new_fingerprint")


DETAILS = "details string, detail string, description string, card_texts array<string>, product_name string"


def repaired_details(items: DataFrame, markers: tuple[str, ...] = ()) -> DataFrame:
    """Items with ``outcome`` and ``after``: details that are a JSON object become their text.

    invalid: looks like an object but is none; noop: no object, or the same text; unresolved: an object
    without a usable text; updated: the rest.
    """
    raw = F.coalesce("details", F.lit(""))
    whole = F.get_json_object(raw, "$")
    is_object = F.coalesce(F.startswith(C.trim(whole), F.lit("{")), F.lit(False))
    looks = F.startswith(C.trim(raw), F.lit("{")) & F.endswith(C.trim(raw), F.lit("}"))
    out = items.withColumn("_o", F.when(is_object, F.from_json(raw, DETAILS)))
    out = out.withColumn("after", F.when(is_object, C.details_text("_o.details", "_o.detail", "_o.description", "_o.card_texts", "_o.product_name", markers)))
    outcome = F.when(~is_object, F.when(looks, "invalid").otherwise("noop")).when(F.col("after").isNull(), "unresolved").when(raw == F.col("after"), "noop").otherwise("updated")
    return out.withColumn("outcome", outcome).drop("_o")
