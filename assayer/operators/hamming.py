"""Nearest reference hash by multi-index hashing.

A hash of 64 bits is cut into m segments.  If two hashes differ in at most m (r + 1) - 1 bits, one
segment differs in at most r bits, so an index of references by segment and value, asked for all values within r
bits of an image's, meets every such reference.  Rings r = 0, 1, 2, ... are asked in turn, each for those
hashes only whose best distance so far is above what the rings before can prove.  Many references are asked
by four segments of 16 bits first, whose lists are short, and by bytes after that.

Images and references meet by an equi-join on (segment, value); hashes that occur often are looked up once.  Exact
for all distances: the last ring of the bytes meets everything that is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import saved

#: With more references than this the 16-bit segments are asked first.
MANY = 4096


def steps(references: int) -> list[tuple[int, list[int], int]]:
    """(bits of a segment, rings, distance proved after them)."""
    wide = [(16, [r], 4 * (r + 1) - 1) for r in range(3)] if references > MANY else []
    narrow = [(8, [0, 1] if wide and r == 1 else [r], min(8 * (r + 1) - 1, 64)) for r in range(1 if wide else 0, 9)]
    return wide + narrow


def _segments(hash_: str, width: int) -> Column:
    """The values of all segments, each with its number above it."""
    cut = lambda k: F.shiftrightunsigned(hash_, k * width).bitwiseAND((1 << width) - 1) + (k << width)
    return F.array(*(cut(k).cast("long") for k in range(64 // width)))


def index(references: DataFrame, width: int) -> DataFrame:
    """key, _reference: each distinct reference under its segments."""
    return references.select(F.explode(_segments("_reference", width)).alias("key"), "_reference")


def candidates(hashes: DataFrame, keys: DataFrame, width: int, rings: list[int]) -> DataFrame:
    """(phash, _reference) that have a segment whose values differ in as many bits as a ring says."""
    masks = F.lit([m for m in range(1 << width) if m.bit_count() in rings])
    asked = hashes.select("phash", F.explode(_segments("phash", width)).alias("_segment")).select("phash", F.explode(F.transform(masks, lambda m: F.col("_segment").bitwiseXOR(m.cast("long")))).alias("key"))
    # both sides are exploded, so their sizes are not known beforehand; neither may be sent through the driver
    return asked.join(keys.hint("merge"), "key").select("phash", "_reference")


def nearest_hash(images: DataFrame, references: DataFrame) -> DataFrame:
    """The images with ``distance``: least number of differing bits to a reference.

    Both have a column phash (long).  Null hashes take no part; a null hash, or no reference at all, gives a null distance.
    """
    known = saved(references.select(F.col("phash").alias("_reference")).filter("_reference IS NOT NULL").distinct())
    n = known.count()
    if not n:
        return images.withColumn("distance", F.lit(None).cast("int"))
    left = images.select("phash").filter("phash IS NOT NULL").distinct().withColumn("distance", F.lit(None).cast("int"))
    done, indexes = [], {}
    for width, rings, proved in steps(n):
        if width not in indexes:
            indexes[width] = saved(index(known, width))
        bits = F.bit_count(F.col("phash").bitwiseXOR(F.col("_reference")))
        found = candidates(left, indexes[width], width, rings).groupBy("phash").agg(F.min(bits).alias("_d"))
        at = saved(left.join(found.hint("merge"), "phash", "left").select("phash", F.least("distance", "_d").alias("distance")))
        settled = F.coalesce(F.col("distance") <= proved, F.lit(False))
        done.append(at.filter(settled))
        left = at.filter(~settled)
        if left.isEmpty():
            break
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return images.join(every.hint("merge"), "phash", "left").select(*images.columns, "distance")
