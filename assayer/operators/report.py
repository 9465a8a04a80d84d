"""Counters, totals and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.shared import saved

#: Keys that are sent to all tasks at most.
FEW = 100_000


def outcome_counts(rows: DataFrame, outcomes: list[str], by: str | None = None, outcome: str = "outcome") -> DataFrame:
    """One column for each outcome, by file or in all."""
    counts = [F.count_if(F.col(outcome) == o).alias(o) for o in outcomes]
    return rows.groupBy(by).agg(*counts) if by else rows.agg(*counts)


#: Counters of an enrichment report and the outcome that each counts.
ENRICHMENT = {
    "rows_updated": "updated", "rows_created": "created", "rows_invalid": "invalid", "rows_skipped_noop": "noop", "rows_skipped_ambiguous": "ambiguous",
    "rows_skipped_not_found": "not_found", "rows_skipped_duplicate_in_file": "duplicate_in_file", "rows_skipped_existing_assay": "existing_assay",
}


def enrichment_counts(rows: DataFrame, known_groups: DataFrame, file: str = "file", group: str = "group_id") -> DataFrame:
    """The ten counters of each file; a group counts as created in the first file that creates a row in it."""
    counted = rows.groupBy(file).agg(F.count("*").alias("rows_scanned"), *(F.count_if(F.col("outcome") == o).alias(n) for n, o in ENRICHMENT.items()))
    new = rows.filter("outcome = 'created'").join(known_groups.select(group).distinct(), group, "left_anti").groupBy(group).agg(F.min(file).alias(file))
    made = new.groupBy(file).agg(F.count("*").alias("groups_created"))
    return counted.join(made, file, "left").withColumn("groups_created", F.coalesce("groups_created", F.lit(0)))


def totals(reports: DataFrame, file: str = "file") -> DataFrame:
    """Sums of all counters over the files."""
    return reports.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in reports.columns if c != file))


def feed_summary(rows: DataFrame, outcome: str = "outcome", message: str = "issue") -> DataFrame:
    """Counters of a feed import with the distinct failure messages, sorted."""
    is_ = lambda *o: F.count_if(F.col(outcome).isin(*o))
    return rows.agg(
        F.count("*").alias("rows_total"), (F.count("*") - is_("invalid")).alias("rows_valid"), is_("invalid").alias("rows_invalid"), is_("inserted").alias("products_created"),
        is_("updated").alias("products_updated"), is_("ambiguous").alias("products_skipped"), F.array_sort(F.collect_set(message)).alias("failure_messages"),
    )


def deliveries(recipients: DataFrame, campaign: str = "campaign", status: str = "status") -> DataFrame:
    """Recipients, delivered and failed of each campaign."""
    return recipients.groupBy(campaign).agg(F.count("*").alias("total_recipients"), F.count_if(F.col(status) == "sent").alias("delivered_count"), F.count_if(F.col(status) == "failed").alias("failed_count"))


def histogram(df: DataFrame, column: str, name: str = "status") -> DataFrame:
    """Rows of each value."""
    return df.groupBy(F.col(column).alias(name)).agg(F.count("*").alias("n"))


def union_keys(*reports: DataFrame) -> DataFrame:
    """Keys that any of the reports holds, once each."""
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out.distinct()


def unmatched(have: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of ``have`` that ``wanted`` lacks, once each."""
    return have.select(*keys).distinct().join(wanted.select(*keys).distinct(), keys, "left_anti")


def children_counts(parents: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """Number of children of each kind, 0 if none."""
    out = parents
    for name, df in children.items():
        out = out.join(df.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def analyses(items: DataFrame) -> DataFrame:
    """By family: rows, distinct analyses, exact duplicates."""
    sig = C.assay_text("weight_kg", "pt_ppm", "pd_ppm", "rh_ppm")
    key = C.normalize_serial("serial_code").alias("serial")
    d = F.count_distinct(sig)
    return items.groupBy("group_id", key).agg(F.count("*").alias("n"), d.alias("analyses"), (F.count("*") - d).alias("duplicates"))


def families(items: DataFrame) -> DataFrame:
    """Families, those with several analyses, and duplicates in all."""
    return analyses(items).agg(F.count("*").alias("families"), F.count_if(F.col("analyses") > 1).alias("multi"), F.sum("duplicates").alias("duplicates"))


def ambiguous(pairs: DataFrame, key: str, target: str) -> DataFrame:
    """Keys with several targets, with the sorted list."""
    s = F.collect_set(target)
    return pairs.groupBy(key).agg(F.size(s).alias("n"), F.array_join(F.array_sort(s), "|").alias("targets")).filter("n > 1")


def ambiguous_links(pairs: DataFrame, key: str, target: str) -> DataFrame:
    """The same keys with one row for each target, however many a key has; the links are written once for both passes."""
    links = saved(pairs.select(key, target).distinct())
    several = saved(links.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key))
    # a few frequent keys would bring all links to a few tasks
    return links.join(F.broadcast(several) if several.count() <= FEW else several.hint("merge"), key, "left_semi")


def copies(families_: DataFrame, n: str = "n") -> DataFrame:
    """Items with a source, and copies to siblings."""
    return families_.agg(F.sum(n).alias("items"), F.sum(F.greatest(F.col(n) - 1, F.lit(0))).alias("copies"))


def cost(candidates: DataFrame, unit: float, verify_unit: float, ceiling: float) -> DataFrame:
    """Cost of the candidates in two tiers, against a ceiling."""
    n = F.count("*")
    return candidates.agg(n.alias("n"), F.round(n * unit, 6).alias("cost"), F.round(n * (unit + verify_unit), 6).alias("cost_verified"), (n * (unit + verify_unit) > ceiling).alias("over"))


def header_rows(cells: DataFrame, rows: int = 3, columns: int = 25) -> DataFrame:
    """(file, sheet, row): the best header row among the first, by the weights of its roles.

    Fixed values: model and serial 5, weight 3, codes, details and shape 2, metals 1.
    """
    role = C.header_role("raw")
    score = F.when(role.isin("model", "serial"), 5).when(role == "weight", 3).when(role.isin("extra_codes", "details", "shape_code"), 2).when(role.isNotNull(), 1).otherwise(0)
    scored = cells.filter((F.col("row") <= rows) & (F.col("col") <= columns)).groupBy("file", "sheet", "row").agg(F.sum(score).alias("score"))
    w = Window.partitionBy("file", "sheet").orderBy(F.desc("score"), "row")
    return scored.withColumn("_n", F.row_number().over(w)).filter("_n = 1 AND score > 0").drop("_n")


#: So many rows of sheets are sent to every task; beyond that both sides are sorted.
FEW_SHEETS = 10_000


def with_sheets(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """Cells or rows with the row of their sheet in ``sheets``, best a written table.

    Sizes of exploded and grouped tables are guesses, by which the cells could be sent through the driver to all tasks, so the
    sheets are counted and it is said which side may be sent.
    """
    return cells.join(sheets.hint("broadcast" if sheets.count() <= FEW_SHEETS else "merge"), ["file", "sheet"])


#: Columns of a sheet without a usable header, and its first row of data.
FALLBACK = {"model": 1, "serial": 2, "weight": 3, "pt": 4, "pd": 6, "rh": 8, "extra_codes": 11, "details": 13, "shape_code": 17}
FALLBACK_START = 4


def layouts(cells: DataFrame) -> DataFrame:
    """(file, sheet, start_row, a column for each role): first column of the role, else its usual place."""
    heads = header_rows(cells)
    # of a sheet only its three header rows meet
    top = cells.filter("row <= 3 AND col <= 25").withColumn("role", C.header_role("raw")).filter("role IS NOT NULL")
    roles = top.join(heads.select("file", "sheet", "row").hint("merge"), ["file", "sheet", "row"])
    found = roles.groupBy("file", "sheet").agg(F.max("row").alias("_row"), *(F.min(F.when(F.col("role") == r, F.col("col"))).alias(r) for r in FALLBACK))
    sheets = cells.select("file", "sheet").distinct()
    out = sheets.join(found.hint("merge"), ["file", "sheet"], "left")
    start = F.greatest(F.coalesce(F.col("_row") + 1, F.lit(FALLBACK_START)), F.lit(FALLBACK_START))
    return out.select("file", "sheet", start.alias("start_row"), *(F.coalesce(F.col(r), F.lit(p)).alias(r) for r, p in FALLBACK.items()))


def exact_metal_columns(cells: DataFrame) -> DataFrame:
    """For each sheet the last column whose header is just the metal, else the first that holds its name."""
    key, role = C.header_key("raw"), C.header_role("raw")
    pick = lambda m: F.coalesce(F.max(F.when(key == m, F.col("col"))), F.min(F.when(role == m, F.col("col")))).alias(m)
    return cells.groupBy("file", "sheet").agg(*(pick(m) for m in ("pt", "pd", "rh")))


def pivoted_rows(cells: DataFrame, layout: DataFrame) -> DataFrame:
    """One row per sheet row from its first row of data, a column for each role (raw text)."""
    at = with_sheets(cells.filter("col <= 25"), layout).filter("row >= start_row")
    return at.groupBy("file", "sheet_idx", "sheet", "row").agg(*(F.max(F.when(F.col("col") == F.col(r), F.col("raw"))).alias(r) for r in FALLBACK))


def has_headers(cells: DataFrame, required: list[str], rows: int = 3) -> DataFrame:
    """(file, sheet, row, overlap, fits): the row with most of the required headers."""
    want = F.array(*map(F.lit, required))
    each = cells.filter(F.col("row") <= rows).groupBy("file", "sheet", "row").agg(F.collect_set(C.header_key("raw")).alias("_have"))
    each = each.withColumn("overlap", F.size(F.array_intersect("_have", want))).withColumn("fits", F.size(F.array_except(want, F.col("_have"))) == 0)
    w = Window.partitionBy("file", "sheet").orderBy(F.desc("overlap"), "row")
    return each.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_have")


def gram_sheets(cells: DataFrame, layout: DataFrame) -> DataFrame:
    """``multiplier``: 1000 for sheets whose headers all say grams per kilogram, else 1.

    The header rows are the formula row above the metals, their names and the unit.
    """
    head = F.col("start_row") - 3
    near = with_sheets(cells, layout.select("file", "sheet", "start_row", "weight", "pt", "pd", "rh")).filter(F.col("row").between(head, head + 2))
    key = C.header_key("raw")
    is_at = lambda c, d: (F.col("col") == F.col(c)) & (F.col("row") == head + d)
    tests = {"weight": is_at("weight", 0) & (key == "piecekg"), "formula": is_at("pt", 0) & F.lower(C.trim("raw")).startswith("=sum(kitko!"), "price": (F.col("col") == F.col("rh") + 2) & (F.col("row") == head + 2) & (key == "priceuspiece")}
    for m in ("pt", "pd", "rh"):
        tests[m] = is_at(m, 1) & (key == m)
        tests[f"{m}_ppm"] = is_at(m, 2) & (key == "ppm")
    flags = near.groupBy("file", "sheet").agg(*(F.max(t.cast("int")).alias(f"_{n}") for n, t in tests.items()))
    all_ok = F.lit(True)
    for n in tests:
        all_ok = all_ok & (F.col(f"_{n}") == 1)
    return layout.select("file", "sheet").join(flags.hint("merge"), ["file", "sheet"], "left").select("file", "sheet", F.when(all_ok, 1000.0).otherwise(1.0).alias("multiplier"))
