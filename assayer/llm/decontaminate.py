"""Benchmark decontamination by Wu-Manber multi-pattern search.

Patterns are windows of 13 consecutive words of benchmark items (the whole item if
it has fewer words).  Documents and items are brought to one form: A-Z in lower
case, words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with one space between and
around them, as UTF-8 bytes.  A window then occurs where its bytes occur.

The search keeps, for each class of pattern lengths, a shift table over blocks of
bytes (a block that no pattern holds lets the search skip almost a whole pattern),
buckets by the hash of the patterns' last block, and compares the patterns of a
bucket directly.  The tables of at most ``block_bytes`` of item text are broadcast at
a time; a larger benchmark is searched in several such blocks, each against all
documents, and the hits are united by the row's number, which is written once before.

Null texts have no words.  Items without words have no window.  Items with equal
text are reported each under its own id; an item whose id is null is reported as
``null``.  Every document is a row of its own, whatever its id and the number of blocks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, saved, slices, table, two_columns

WINDOW = 13

#: Bytes of words are digits, letters and all that is not ASCII.
_FORM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_FORM).split() if text else []


class WuManber:
    """Search for byte strings of at least ``shortest`` bytes."""

    def __init__(self, patterns: list[bytes]):
        self.m = m = min(map(len, patterns))
        self.block = b = max(1, min(8, m // 2))
        self.skip = m - b + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, list[bytes]] = defaultdict(list)
        for p in set(patterns):
            for k in range(m - b + 1):
                block, far = p[k : k + b], m - b - k
                if far < self.shift.get(block, self.skip):
                    self.shift[block] = far
            self.buckets[p[m - b : m]].append(p)

    def find(self, text: bytes) -> list[tuple[int, bytes]]:
        """(offset, pattern) of all occurrences, overlapping ones too."""
        found, m, b, far = [], self.m, self.block, self.skip
        shift, buckets = self.shift.get, self.buckets
        at, end = m - b, len(text) - b
        while at <= end:
            step = shift(text[at : at + b], far)
            if step:
                at += step
                continue
            start = at + b - m
            for p in buckets[text[at : at + b]]:
                if text.startswith(p, start):
                    found.append((start, p))
            at += 1
        return found


class Scanner:
    """Tables for a block of items: one search for each class of pattern lengths."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.owners: dict[bytes, set[str]] = defaultdict(set)
        for item, text in items:
            w = words(text.encode() if text else None)
            for k in range(max(len(w) - window, 0) + 1 if w else 0):
                self.owners[b" " + b" ".join(w[k : k + window]) + b" "].add(item)
        classes = defaultdict(list)
        for p in self.owners:
            classes[min(len(p).bit_length(), 7)].append(p)
        self.searches = [WuManber(ps) for ps in classes.values()]

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Number of words, maximal runs of hit words, items found."""
        w = words(text)
        form = b" " + b" ".join(w) + b" "
        hits = [h for s in self.searches for h in s.find(form)] if w else []
        if not hits:
            return len(w), [], []
        spaces = np.flatnonzero(np.frombuffer(form, np.uint8) == 32)
        spans, items = [], set()
        for start, p in hits:
            first = int(np.searchsorted(spaces, start))
            spans.append((first, first + p.count(b" ") - 1))
            items |= self.owners[p]
        return len(w), united(spans), sorted(items)


def united(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scanner(shipped, key: tuple[int, int]) -> Scanner:
    """One scanner for each worker process and block of items."""
    return held(("scanner", *key), lambda: Scanner(shipped.value, key[1]))


def _ship(df: DataFrame, items: list[tuple[str, str | None]]):
    return df.sparkSession.sparkContext.broadcast(items)


def _scan(df: DataFrame, shipped, window: int) -> DataFrame:
    key = (shipped._jbroadcast.id(), window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(shipped, key)
        for batch, texts in slices(batches):
            rows = [scanner.scan(t) for t in texts]
            spans = pa.array([[{"start": a, "end": b} for a, b in r[1]] for r in rows], _SPANS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), spans, pa.array([r[2] for r in rows], pa.list_(pa.string()))], ["doc_id", "n_words", "hit_spans", "item_ids"])

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_words long, hit_spans array<struct<start:long,end:long>>, item_ids array<string>")


def _cut(items: DataFrame, item_id: str, item_text: str, block_bytes: int) -> tuple[DataFrame, int]:
    """The items as item and text, and the number of blocks whose texts have about ``block_bytes`` at most; one if all fit."""
    wanted = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(item_text).cast("string").alias("text"))
    size = wanted.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 32)).first()[0] or 0
    return wanted, -(-2 * size // block_bytes) if size > block_bytes else 1


def _block(wanted: DataFrame, blocks: int, k: int) -> list[tuple[str, str | None]]:
    part = wanted if blocks == 1 else wanted.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
    return [(r[0], r[1]) for r in part.collect()]  # no more than a block


def _unite(df: DataFrame) -> DataFrame:
    """Hits of one document from several blocks as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"start": a, "end": b} for a, b in united((s["start"], s["end"]) for s in row)] for row in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, _SPANS), batch.column(3)], ["doc_id", "n_words", "hit_spans", "item_ids"])

    flat = lambda c: F.flatten(F.collect_list(c))
    each = df.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), flat("hit_spans").alias("hit_spans"), F.array_sort(F.array_distinct(flat("item_ids"))).alias("item_ids"))
    return each.mapInArrow(run, df.schema)


def scan(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = 16 << 20) -> DataFrame:
    """One row per document: doc_id, n_words, hit_spans (runs of hit words, end exclusive), item_ids.

    ``items`` is read on the driver only in blocks of at most ``block_bytes`` (or one
    item, if that is longer).
    """
    df = two_columns(docs, id_col, text_col)
    wanted, blocks = _cut(items, item_id, item_text, block_bytes)
    if blocks == 1:
        return _scan(df, _ship(df, _block(wanted, 1, 0)), window)
    # ids may be null or repeat, so blocks meet by a number of the row that is written once
    numbered = saved(df.withColumn("_row", F.monotonically_increasing_id()))
    texts = numbered.select(F.col("_row").alias("doc_id"), "text")
    parts = []
    for k in range(blocks):  # one block at a time is held by the driver and the workers
        shipped = _ship(df, _block(wanted, blocks, k))
        parts.append(saved(_scan(texts, shipped, window)))
        shipped.destroy()
    union = reduce(DataFrame.unionByName, parts)
    united_rows = _unite(union).withColumnRenamed("doc_id", "_row")
    return numbered.select("_row", "doc_id").join(united_rows, "_row").drop("_row")


def judged(scanned: DataFrame, percent: int = 5) -> DataFrame:
    """Adds n_hit, n_items and contaminated: a hit, and at least ``percent`` of the words are hit."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return scanned.withColumn("n_hit", n_hit).withColumn("n_items", F.size("item_ids").cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words")))


def clean(docs: DataFrame, items: DataFrame, percent: int = 5, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns.

    With one block of items the rows are filtered where they are; with more, they are written
    once with a row number, by which the hits of the blocks are united.
    """
    wanted, blocks = _cut(items, item_id, item_text, block_bytes)
    if blocks == 1:
        shipped = _ship(docs, _block(wanted, 1, 0))
        key = (shipped._jbroadcast.id(), window)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scanner = _scanner(shipped, key)
            for batch, texts in slices(batches, text_col):
                hits = [(n, sum(b - a for a, b in spans)) for n, spans, _ in map(scanner.scan, texts)]
                yield batch.filter(pa.array([not h or 100 * h < percent * n for n, h in hits], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)
    names = [f"c{k}" for k in range(len(docs.columns))]  # so that no column clashes with the number
    keyed = saved(docs.toDF(*names).withColumn("number", F.monotonically_increasing_id()))
    bad = judged(scan(keyed, items, "number", names[docs.columns.index(text_col)], item_id, item_text, window, block_bytes), percent).filter("contaminated")
    return keyed.join(bad.select(F.col("doc_id").alias("number")), "number", "left_anti").select(*names).toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    rows = judged(scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", F.array_sort("item_ids")).cast("binary"), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') AS s
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
grams AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS s
          FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS p FROM d, sizes WHERE len(w) >= k)),
hits AS (SELECT doc_id, p, g.k, item_id FROM grams g JOIN win USING (k, s)),
hit_words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + k - 1)) AS q FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN found USING (doc_id)
"""
