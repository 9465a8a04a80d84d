"""JSON arrays of objects, read in parallel and written one for each partition (A1).

``read.json(multiLine=True)`` reads one array file in one task.  Here a file is cut at every ``}`` by the text reader, which
splits files at byte ranges.  Whether a cut stands inside a string, and at which depth, depends on all bytes before
it, so each byte range (block) is summed up first: the parity of its quotes, and what its brackets add to the
depth if it begins outside or inside a string.  Running sums over the blocks of a file, one row each, give the
state in which every block begins; running sums within a block then give the state after every piece.  A piece that
ends outside strings at depth 1 ends a record.  Records of several pieces are put together, within a block by their end,
and over blocks from the last piece of one and the first of the next.

A file whose root is not an array, that is cut short, or that is empty is an error at once; a record that is no object or that
does not fit the schema, and anything but one comma between two records, is an error when it is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLOCK = ["_file", "_block"]


def _opened(outside: Column) -> Column:
    """What brackets outside strings add to the depth."""
    count = lambda s: F.length(outside) - F.length(F.translate(outside, s, ""))
    return count("[{") - count("]")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Pieces with the parity of their quotes and the change of depth if they begin outside (in0) or inside a string (in1); the brace after a piece counts."""
    raw = spark.read.option("lineSep", "}").text(path)
    pieces = raw.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), "value")
    plain = F.regexp_replace("value", r"\\[\s\S]", "")
    odd = (F.length(plain) - F.length(F.translate(plain, '"', ""))) % 2
    outside0 = F.regexp_replace(plain, r'"[^"]*("|$)', "")
    outside1 = F.regexp_replace(F.regexp_replace(plain, r'^[^"]*("|$)', ""), r'"[^"]*("|$)', "")
    brace = lambda begins: F.when((odd + begins) % 2 == 0, 1).otherwise(0)
    return pieces.select("*", odd.alias("_odd"), (_opened(outside0) - brace(0)).alias("_in0"), (_opened(outside1) - brace(1)).alias("_in1"))


def _summed(pieces: DataFrame) -> DataFrame:
    """Within each block: parity before a piece and depth after it, for both states the block may begin in."""
    w = Window.partitionBy(*_BLOCK).orderBy("_at")
    before = F.coalesce(F.sum("_odd").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    deeper = lambda begins: F.when((F.col("_before") + begins) % 2 == 0, F.col("_in0")).otherwise(F.col("_in1"))
    return pieces.withColumn("_before", before).withColumns({"_depth0": F.sum(deeper(0)).over(upto), "_depth1": F.sum(deeper(1)).over(upto)})


def _states(pieces: DataFrame) -> DataFrame:
    """One row for each block: whether it begins in a string, and at which depth; and the same for its end."""
    last = lambda c: F.max_by(c, "_at")
    blocks = _summed(pieces.drop("value")).groupBy(*_BLOCK).agg((F.sum("_odd") % 2).alias("_odd"), last("_depth0").alias("_d0"), last("_depth1").alias("_d1"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_inside", (F.coalesce(F.sum("_odd").over(earlier), F.lit(0)) % 2).cast("int"))
    blocks = blocks.withColumn("_added", F.when(F.col("_inside") == 0, F.col("_d0")).otherwise(F.col("_d1")))
    return blocks.withColumn("_base", F.coalesce(F.sum("_added").over(earlier), F.lit(0))).select(*_BLOCK, "_inside", "_base", (F.col("_base") + F.col("_added")).alias("_end"), ((F.col("_inside") + F.col("_odd")) % 2).alias("_end_inside"))


def _checked(states: DataFrame, files: list[str]) -> None:
    # the brace that the reader takes off is counted after the last piece too, where there is none
    at_end = states.groupBy("_file").agg(F.max_by("_end", "_block").alias("d"), F.max_by("_end_inside", "_block").alias("s"))
    good = F.col("d").eqNullSafe(-1) & F.col("s").eqNullSafe(0)
    r = at_end.agg(F.count("*").alias("n"), F.min(F.when(~good, F.col("_file"))).alias("bad")).first()
    if r.bad is not None:
        raise ValueError(f"no whole JSON array: {r.bad}")
    if r.n < len(files):  # an empty file has no piece
        raise ValueError("no whole JSON array: an empty file")


def array_texts(spark: SparkSession, path: str) -> DataFrame:
    """``value``: the text of each record of the arrays at ``path``."""
    pieces = _pieces(spark, path)
    states = _states(pieces)
    _checked(states, spark.read.text(path).inputFiles())
    w = Window.partitionBy(*_BLOCK).orderBy("_at")
    at = _summed(pieces).join(states.select(*_BLOCK, "_inside", "_base"), _BLOCK)
    depth = F.col("_base") + F.when(F.col("_inside") == 0, F.col("_depth0")).otherwise(F.col("_depth1"))
    at = at.withColumn("_depth", depth).withColumn("_border", (F.col("_depth") == 1) & ((F.col("_inside") + F.col("_before") + F.col("_odd")) % 2 == 0))
    at = at.withColumn("_opens", (F.col("_block") == 0) & F.lag("_at").over(w).isNull())  # the first piece of its file
    own = F.coalesce(F.max("_border").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)) | ((F.col("_base") == 1) & (F.col("_inside") == 0)) | (F.col("_block") == 0)
    # backwards, since Spark goes over all rows of a frame that ends unbounded again for every row
    back = Window.partitionBy(*_BLOCK).orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumns({"_own": own, "_last": F.last(F.when(F.col("_border"), F.col("_at")), ignorenulls=True).over(back)})
    alone = F.coalesce(F.lag("_border").over(w), (F.col("_block") == 0) | ((F.col("_base") == 1) & (F.col("_inside") == 0)))
    at = at.withColumn("_alone", F.col("_border") & alone)
    wrong = lambda what: F.raise_error(F.concat(F.lit(f"{what} in the JSON array "), F.col("_file")))

    end = F.col("value").rlike(r"^\s*(\[\s*)?\]\s*$") & (F.col("_opens") | ~F.col("value").contains("["))
    outside = (F.col("_inside") + F.col("_before") + F.col("_odd")) % 2 == 0
    kept = F.when((F.col("_depth") == -1) & ~end, wrong("unexpected text").cast("boolean")).when((F.col("_depth") < -1) | ((F.col("_depth") == 0) & outside), wrong("unexpected bracket").cast("boolean")).otherwise(F.col("_depth") != -1)
    inside = at.filter(kept)
    # readers' filters may be moved before this one, so other pieces have no text that they could fail on
    whole = inside.filter("_alone").select("_file", "_opens", F.when(F.col("_alone"), F.concat("value", F.lit("}"))).alias("value"))

    parts = inside.filter("NOT _alone").select(*_BLOCK, "_at", "_opens", "_own", "_last", "_border", F.concat("value", F.lit("}")).alias("value"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "value"))), lambda x: x["value"]), "").alias("value")
    started = parts.filter("_own AND _last IS NOT NULL").groupBy(*_BLOCK, "_last").agg(F.max("_opens").alias("_opens"), text).select("_file", "_opens", "value")
    # what is left belongs to records over several blocks: one text before a block's first border, and one after its last
    edges = parts.filter("NOT _own OR _last IS NULL").groupBy(*_BLOCK, "_own").agg(F.max("_opens").alias("_opens"), F.max("_border").alias("_ends"), text)
    line = Window.partitionBy("_file").orderBy("_block", "_own")
    ended = F.coalesce(F.sum(F.col("_ends").cast("int")).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_block", "_own", "value"))), lambda x: x["value"]), "").alias("value")
    across = edges.withColumn("_record", ended).groupBy("_file", "_record").agg(F.max("_opens").alias("_opens"), joined).select("_file", "_opens", "value")

    records = whole.unionByName(started).unionByName(across)
    body = F.when(F.col("_opens"), F.regexp_extract("value", r"^\s*\[\s*(\{[\s\S]*)$", 1)).otherwise(F.regexp_extract("value", r"^\s*,\s*(\{[\s\S]*)$", 1))
    return records.select(F.when(F.col("value").isNotNull(), F.when(body == "", wrong("something else than a record")).otherwise(body)).alias("value"))


def array_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The records of the arrays at ``path``, as ``read.json`` gives them with multiLine and FAILFAST, but over many tasks."""
    return array_texts(spark, path).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def write_arrays(df: DataFrame, path: str) -> None:
    """Writes rows as JSON arrays, one file for each partition."""
    rows = df.select(F.to_json(F.struct(*df.columns)).alias("value"))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "["
        for batch in batches:
            out = []
            for v in batch.column(0).to_pylist():
                out.append(mark + v)
                mark = ","
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})
        yield pa.RecordBatch.from_pydict({"value": ["[]" if mark == "[" else "]"]})

    rows.mapInArrow(lines, "value string").write.mode("overwrite").text(path)
