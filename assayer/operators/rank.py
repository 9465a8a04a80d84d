"""Positions and pages over a whole table without a task that sees all rows.

Rows are dealt by ranges of the whole order and sorted there, so neither a hot day nor ties in
a leading column meet in one task.  A row's position is its place in its range plus
the rows of the ranges before, from a table of one row for each range.  The order must be total.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import saved

#: Rows of a range, about: a task sorts so many however large the table is.
RANGE = 500_000
_PLACE_BITS = 33  # of monotonically_increasing_id; the range's number stands above

#: Columns of an order; True: descending.  Nulls come first, or last if descending.
Order = list[tuple[str, bool]]


def columns(order: Order) -> list[Column]:
    return [F.desc(c) if down else F.asc(c) for c, down in order]


def parts(rows: int) -> int:
    """How many ranges or tasks rows are dealt over."""
    return max(1, -(-rows // RANGE))


class Ranges(NamedTuple):
    """A table in order: ``rows`` with ``_range`` and ``_place``, and ``before``: ``_range``, the rows before it and its own."""

    rows: DataFrame
    before: DataFrame


def ranges(df: DataFrame, order: Order) -> Ranges:
    """Deals rows by ranges of the order, writes them once, and counts each range."""
    by = columns(order)
    at = F.monotonically_increasing_id()
    # without a number, ranges are put together by their compressed bytes, which may be many times larger in memory
    n = parts(df.count())
    dealt = df.repartitionByRange(n, *by) if n > 1 else df.repartitionByRange(*by)  # few rows are left to Spark
    dealt = dealt.sortWithinPartitions(*by).withColumn("_at", at)
    # the borders are sampled, so they hold for what was written and no second time
    rows = saved(dealt.withColumns({"_range": F.shiftright("_at", _PLACE_BITS).cast("int"), "_place": F.col("_at").bitwiseAND((1 << _PLACE_BITS) - 1)}).drop("_at"), "_range")
    each = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    # one row for each range, however many rows the table has
    sums = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    return Ranges(rows, each.withColumn("_before", F.coalesce(sums, F.lit(0))))


def ranked(df: DataFrame, order: Order, name: str = "position") -> DataFrame:
    """The rows with their position in the whole order, from 0."""
    rows, before = ranges(df, order)
    # a row for each range
    return rows.join(F.broadcast(before.select("_range", "_before")), "_range").select(*df.columns, (F.col("_before") + F.col("_place")).alias(name))


def page_at(table: Ranges, number: int, size: int) -> DataFrame:
    """A page by number, with its positions; only the ranges that overlap it are read (F1)."""
    start = (max(number, 1) - 1) * size
    inside = table.before.filter((F.col("_before") < start + size) & (F.col("_before") + F.col("_n") > start))
    hit = {r["_range"]: r["_before"] for r in inside.collect()}  # no more than ranges
    rows = table.rows.filter(F.col("_range").isin(list(hit)))
    offset = F.lit(0).cast("long")
    for k, before in hit.items():
        offset = F.when(F.col("_range") == k, F.lit(before).cast("long")).otherwise(offset)
    rows = rows.withColumn("position", offset + F.col("_place")).filter((F.col("position") >= start) & (F.col("position") < start + size))
    return rows.drop("_range", "_place").orderBy("position")


def beyond(order: Order, cursor: dict) -> Column:
    """Rows after the cursor's values in the order."""
    after, same = F.lit(False), F.lit(True)
    for c, down in order:
        v = cursor[c]
        if v is None:
            more = F.lit(False) if down else F.col(c).isNotNull()
        else:
            more = (F.col(c) < F.lit(v)) | F.col(c).isNull() if down else F.coalesce(F.col(c) > F.lit(v), F.lit(False))
        after = after | (same & more)
        same = same & F.col(c).eqNullSafe(F.lit(v))
    return after


def page_after(df: DataFrame, order: Order, size: int, cursor: dict | None = None) -> DataFrame:
    """The next rows after a cursor (F1): no row before it is sorted or sent, however deep the page is."""
    rows = df.filter(beyond(order, cursor)) if cursor is not None else df
    return rows.orderBy(*columns(order)).limit(size)


def cursor_of(page: DataFrame, order: Order) -> dict | None:
    """The cursor behind a page: the values of its last row, None for an empty page."""
    rows = page.select(*(c for c, _ in order)).collect()  # a page
    return rows[-1].asDict() if rows else None
