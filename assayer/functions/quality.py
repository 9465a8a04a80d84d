"""Predicates and issue codes of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import columns as C

#: Parts of image addresses that show a stand-in.
REJECTED_IMAGES = ["/mascots/", "mascote_en", "placeholder", "default-image", "default_image", "no-image", "no_image"]


def priceable(weight="weight_kg", pt="pt_ppm", pd="pd_ppm", rh="rh_ppm") -> Column:
    return C.positive(weight) & C.any_metal(pt, pd, rh)


def rejected_image(url, fragments=REJECTED_IMAGES) -> Column:
    low = F.lower(C._c(url))
    return reduce(lambda a, f: a | low.contains(f), fragments, ~low.rlike("^https?://"))


def has_data(*fields) -> Column:
    """Any of the fields is there."""
    return F.coalesce(*(C.blank_to_null(C._c(f).cast("string")) for f in fields)).isNotNull()


def ambiguous_assay(raw, value) -> Column:
    """A cell with something in it that gave no number and is no formula or error."""
    r = C.trim(F.coalesce(C._c(raw), F.lit("")))
    plain = F.translate(r, ",' ", ".")
    odd = ~plain.rlike(C.NUMBER) | r.rlike(r"[/;|]") | r.rlike(r"\d+\s*-\s*\d+") | r.rlike(r"\p{L}")
    return (r != "") & ~r.rlike("^[=#]") & C._c(value).isNull() & odd


def issue_code(serial, model, weight, pt, pd, rh, raw: tuple | None = None) -> Column:
    """The first rule that a row breaks, null if none."""
    unclear = F.lit(False)
    if raw:
        unclear = reduce(lambda a, b: a | b, (ambiguous_assay(r, v) for r, v in zip(raw, (pt, pd, rh))))
    text = F.upper(F.coalesce(C._c(serial), F.lit("")))
    return (
        F.when(C.blank_to_null(serial).isNull(), "missing_serial_code")
        .when(~C.usable_serial(serial) & text.contains(C.CONTROL_ROW), "control_row")
        .when(~C.usable_serial(serial), "invalid_serial_code")
        .when(C.blank_to_null(model).isNull(), "missing_model")
        .when(~C.positive(weight), "missing_or_invalid_weight")
        .when(unclear, "ambiguous_assay_value")
        .when(~C.any_metal(pt, pd, rh), "missing_assay_values")
    )


def valid_row(serial, model, weight, pt, pd, rh) -> Column:
    """A row of the fixed layout: no code, only good or not."""
    return C.usable_serial(serial) & C.blank_to_null(model).isNotNull() & C.positive(weight) & C.any_metal(pt, pd, rh)


def enrichable(serial, model, *fields, unclear=None) -> Column:
    """Serial, model and any figure or shape are there, and no assay is unclear."""
    some = reduce(lambda a, b: a | b, (C._c(f).isNotNull() for f in fields))
    ok = C.usable_serial(serial) & C.blank_to_null(model).isNotNull() & some
    return ok & ~unclear if unclear is not None else ok


def feed_issue(page_url, slug, product_url, serial, name, brand) -> Column:
    missing = lambda c: C.blank_to_null(c).isNull()
    return (
        F.when(missing(page_url), "Missing brand_page_url.")
        .when(C._c(slug).isNull(), "Unable to extract a valid brand slug.")
        .when(missing(product_url), "Missing product_url.")
        .when(missing(serial), "Missing serial_code.")
        .when(missing(name), "Missing product_name.")
        .when(missing(brand), "Unable to derive brand name.")
    )


def skipped_sheets(cells: DataFrame, titles: tuple[str, ...] = ("kitko",)) -> DataFrame:
    """(file, sheet) whose title says so or whose first 20 x 20 cells are empty."""
    title = F.regexp_replace(F.lower(F.col("sheet")), r"(?U)\s+", "")
    named = title.isin(*titles) | title.rlike(r"^лист\d*$")
    filled = cells.filter((F.col("row") <= 20) & (F.col("col") <= 20) & C.blank_to_null("raw").isNotNull()).select("file", "sheet").distinct()
    sheets = cells.select("file", "sheet").distinct()
    return sheets.filter(named).unionByName(sheets.filter(~named).join(filled, ["file", "sheet"], "left_anti"))


def image_verdict(distance, faces, colorfulness, saturation, match) -> Column:
    """(verdict, score): spam by hash or by face, else a wrong mark; null if neither."""
    d, f = C._c(distance), C._c(faces)
    by_hash = F.coalesce(d <= 4, F.lit(False))
    by_face = (f > 0) & (C._c(colorfulness) >= 35) & (C._c(saturation) >= 18)
    wrong = (C._c(match) >= 0.15) & (C._c(colorfulness) >= 20)
    score = F.when(by_hash, F.round(1 - d / 64, 4)).when(by_face, F.round(F.least(F.lit(1.0), 0.4 + 0.1 * f + C._c(colorfulness) / 100), 4)).when(wrong, F.round(C._c(match), 4))
    return F.struct(F.when(by_hash, "spam_hash").when(by_face, "spam_face").when(wrong, "wrong_mark").alias("verdict"), score.alias("score"))


def marked(scores) -> Column:
    """A mark is there: one score of 0.82, or 0.67 and a second of 0.62."""
    s = F.sort_array(scores, asc=False)
    first, second = F.coalesce(F.try_element_at(s, F.lit(1)), F.lit(0.0)), F.coalesce(F.try_element_at(s, F.lit(2)), F.lit(0.0))
    return (first >= 0.82) | ((first >= 0.67) & (second >= 0.62))


def image_issue(variant, method, score, threshold: float = 0.12) -> Column:
    return (C._c(variant) == "original") & C._c(method).contains("pixel_mask") & (C._c(score).try_cast("double") >= threshold)
