"""Mixing sources to target weights by subset-sum budget fitting.

Sizes.  The size of a document is its number of words, the stretches between the characters 0x09-0x0D and 0x20.

Targets.  Sources in the order of their code points, null last, take the weights in
turn and share ``share`` times all words by weight.  No target is above ``most`` times its source; what is
above is shared again by weight among the others, until none is.  Each round is one aggregate over the
table of sources, of which two sums reach the driver.

Fit.  Documents are counted by source and exact size.  For each source a task gets this histogram, whose
length is bounded by the longest document, and decides how often the documents of each size are
taken.  Most of the target is spent evenly, as the same multiple of every count, rounded down; single documents, the
longest first, bring what is left down to a window of at most ``WINDOW`` words and one document.
A bounded knapsack over the counts still free, in lots of one, two, four, ..., finds the sum nearest to what is left.
The window is a sixteenth of the target at first, a quarter and then all of it (up to ``WINDOW``) if no sum hits.
No document is taken more than ``most`` times.

Selection.  If k copies are taken of the c documents of one size, each gets k div c, and the
first k mod c in the order of a seeded hash of the id (then the id) one more.  That order is found without a task for
a whole class: the hash's leading bits deal a class over buckets, about as many as the square root of all rows;
the counts of the buckets before a bucket are a running sum over buckets, and rows are numbered within theirs.
Rows of equal id share a bucket and are alike in all that is returned.

A null or blank text has size 0 and is never taken; a null source is a source; null ids are
ordinary ids; repeated rows count each for itself.  An empty table gives no rows.  Other columns are
not read.  The result depends on the rows, the seed and the parameters alone.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rank import ranked
from .common import saved, table

#: Words that the knapsack may have left to fit, but for one document more.
WINDOW = 1 << 18
_SPACE, _WORD = r"[\x20\x09-\x0D]*", r"[^\x20\x09-\x0D]+"


def word_count(text: str):
    """Words of a text; each, with the space before it, is shortened to one letter."""
    letters = F.regexp_replace(F.col(text).cast("string"), _SPACE + _WORD, "x")
    return F.coalesce(F.length(F.rtrim(letters, F.lit("\t\n\x0b\x0c\r "))), F.lit(0)).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1) -> DataFrame:
    """doc_id, source (a key that sorts as the sources do, null last), size and the seeded hash of the id."""
    key = F.when(F.col(source_col).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string")))
    return docs.select(F.col(id_col).alias("doc_id"), key.alias("source"), word_count(text_col).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col).cast("string")).alias("hash"))


def targets(rows: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """source, source_size, target of each source."""
    sources = ranked(rows.groupBy("source").agg(F.sum("size").alias("source_size")), [("source", False)])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int"))
    sources = saved(sources.select("source", "source_size", weight.cast("long").alias("weight")))
    every = sources.agg(F.sum("source_size").alias("n"), F.sum("weight").alias("w")).first()
    above = lambda level: F.col("weight") * F.lit(level) > most * F.col("source_size")
    capped, level = 0, 0.0
    if every.n:
        level = share * every.n / every.w
        while True:  # the level only rises, so each round caps a source or is the last
            at = sources.agg(F.count_if(above(level)).alias("n"), F.sum(F.when(above(level), most * F.col("source_size"))).alias("full"), F.sum(F.when(~above(level), F.col("weight"))).alias("w")).first()
            if at.n == capped or not at.w:
                break
            capped, level = at.n, (share * every.n - at.full) / at.w
    return sources.select("source", "source_size", F.when(above(level), (most * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def nearest_sum(sizes: np.ndarray, room: np.ndarray, wanted: float) -> tuple[np.ndarray, float]:
    """How many of each size, at most ``room``, sum up nearest to ``wanted`` (of two the smaller sum), and how far that is."""
    taken = np.zeros(len(sizes), np.int64)
    usable = np.flatnonzero((room > 0) & (sizes > 0) & (sizes <= 2 * wanted))
    if not len(usable):
        return taken, wanted
    # a sum above by more than one document, or by more than nothing at all is below, is never nearest
    limit = int(min(2 * wanted, wanted + sizes[usable].max()))
    first = np.full(limit + 1, -1, np.int32)  # the item with which a sum is reached first
    first[0] = 0
    items = [(-1, 0)]
    goal = round(wanted)
    order = usable[np.lexsort((sizes[usable], -room[usable]))]
    left, piece = np.minimum(room, limit // np.maximum(sizes, 1)), 1
    # one of each size, then two of each, four, ...: what is fitted is spread over many sizes
    while first[goal] < 0 and len(order := order[left[order] > 0]):
        for k in order.tolist():
            n = min(piece, int(left[k]))
            step = int(sizes[k]) * n
            new = np.flatnonzero((first[: limit + 1 - step] >= 0) & (first[step:] < 0)) + step
            if len(new):
                first[new] = len(items)
                items.append((k, n))
            left[k] -= n
            if first[goal] >= 0:
                break
        piece *= 2
    sums = np.flatnonzero(first >= 0)
    best = int(sums[np.argmin(np.abs(sums - wanted))])
    away = abs(best - wanted)
    while best:
        k, piece = items[first[best]]
        taken[k] += piece
        best -= int(sizes[k]) * piece
    return taken, away


def fitted(sizes: np.ndarray, counts: np.ndarray, target: float, most: int = 2, window: int = WINDOW) -> np.ndarray:
    """How many documents of each size are taken in all, repeats counted, so that their words come nearest to the target."""
    best, least = np.zeros(len(sizes), np.int64), math.inf
    total = int((sizes * counts).sum())
    if target <= 0 or not total:
        return best
    longest_first = np.argsort(-sizes, kind="stable")
    for part in (16, 4, 1):
        left = min(target / part, window)
        taken = np.minimum(np.floor(counts * ((target - left) / total)).astype(np.int64), most * counts)
        taken[sizes == 0] = 0
        rest = target - float((taken * sizes).sum())
        for k in longest_first.tolist():
            if sizes[k] and rest - sizes[k] >= left and taken[k] < most * counts[k]:
                taken[k] += 1
                rest -= float(sizes[k])
        more, away = nearest_sum(sizes, most * counts - taken, rest)
        if away < least:
            best, least = taken + more, away
        if least <= 0.5 or left == window:
            break
    return best


def budgets(rows: DataFrame, goals: DataFrame, most: int = 2) -> DataFrame:
    """source, size, n (documents of this size), taken (of them, repeats counted), source_size, target."""
    classes = rows.groupBy("source", "size").agg(F.count("*").alias("n")).join(goals, "source")

    def fit(of: pd.DataFrame) -> pd.DataFrame:
        of = of.sort_values("size")
        return of.assign(taken=fitted(of["size"].to_numpy(np.int64), of["n"].to_numpy(np.int64), float(of["target"].iloc[0]), most))

    return classes.groupBy("source").applyInPandas(fit, "source string, size long, n long, source_size long, target double, taken long")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 1) -> DataFrame:
    """doc_id, size, source_size, target, copies (how often the mix takes the document), taken (its words in the mix)."""
    rows = saved(sized(docs, id_col, text_col, source_col, seed))
    bits = math.ceil(math.log2(max(rows.count(), 2)) / 2)
    rows = rows.withColumn("bucket", F.shiftrightunsigned("hash", 64 - bits))
    plan = budgets(rows, targets(rows, weights, share, most), most).withColumnRenamed("taken", "k")
    cell = ["source", "size", "bucket"]
    before = F.sum("m").over(Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    cells = rows.groupBy(*cell).agg(F.count("*").alias("m")).withColumn("before", F.coalesce(before, F.lit(0)))
    once = F.expr("k div n")
    cells = cells.join(plan, ["source", "size"]).select(*cell, "source_size", "target", once.alias("each"), (F.col("k") - F.col("n") * once - F.col("before")).alias("extra"))
    numbered = rows.withColumn("number", F.row_number().over(Window.partitionBy(*cell).orderBy("hash", "doc_id")))
    copies = F.col("each") + F.when(F.col("number") <= F.col("extra"), 1).otherwise(0)
    out = numbered.join(cells, cell).withColumn("copies", copies)
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def query(spark, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
