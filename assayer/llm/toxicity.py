"""Toxicity by a character n-gram linear classifier with naive Bayes scaling.

Features are hashed n-grams of code points (A-Z in lower case), counted once for each
text: 2^20 slots for each order.  With p and q the numbers of toxic and other training texts
that hold a feature, its log-count ratio r = log((p + a) / (n1 + a) / ((q + b) / (n0 + b))) scales
it; a and b are ``smoothing`` pseudo-texts shared out as the labels are, so that the ratio of rare
features is near 0.  A logistic regression is then fitted on all scaled features that
``least`` texts hold at least, by L-BFGS: Spark tasks add up loss and gradient, the driver
holds vectors of one number a slot.

Training uses at most about ``sample_rows`` labelled rows of each label (chosen by a hash of the id
and weighted back to their share), each whole.  All texts are scored whole.  Null and empty
texts get the score of a text without features.  If a document has several labels the
highest counts; null labels do not.  Without labels every score is 0.  Repeated rows are rows
of their own; columns other than id, text and label are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, saved, slices, table

ORDERS = (4, 6)
BITS = 20
#: Bytes of text whose n-grams a task holds at one time.
PIECE_BYTES = 2 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def slots(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the number of the text, and the slot of the order, of every n-gram."""
    sizes, points = [], []
    for t in texts:
        p = np.frombuffer(((t or b"").translate(_LOWER).decode(errors="replace") + "\0" * max(ORDERS)).encode("utf-32-le", "replace"), "<u4")
        points.append(p)
        sizes.append(len(p))
    code = np.concatenate(points).astype(np.uint64) + np.uint64(1)
    of = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    room = np.concatenate([np.arange(n, 0, -1, dtype=np.int32) for n in sizes])  # to the end of the text with its padding
    for n in ORDERS:
        h = np.full(max(0, len(code) - n + 1), n, np.uint64)
        for k in range(n):
            h *= _ODD
            h ^= code[k : k + len(h)]
        h *= _ODD
        fits = room[: len(h)] >= max(ORDERS) + n
        yield of[: len(h)][fits], (h[fits] >> np.uint64(64 - BITS)).astype(np.uint32)


def pairs(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the distinct (text, slot), sorted; at most 2048 texts."""
    for k, (of, slot) in enumerate(slots(texts)):
        each = np.sort((of.astype(np.uint32) << np.uint32(BITS)) | slot)
        each = each[np.append(True, each[1:] != each[:-1])] if len(each) else each
        yield each >> np.uint32(BITS), (each & np.uint32((1 << BITS) - 1)) | np.uint32(k << BITS)


def sampled(docs: DataFrame, labels: DataFrame, sample_rows: int) -> tuple[DataFrame, dict[int, float]]:
    """Training rows (text, y) and how many rows each stands for, by label."""
    known = labels.filter("toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    totals = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not totals:
        return docs.select("text", F.lit(0).alias("y")).limit(0), {}
    share = {y: min(1.0, sample_rows / n) for y, n in totals.items()}
    below = F.when(F.col("y") == 1, F.lit(int(share.get(1, 0) * (1 << 20)))).otherwise(F.lit(int(share.get(0, 0) * (1 << 20))))
    some = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < below)
    # at most about 2 * sample_rows pairs of numbers: bounded, so sent to all
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "y"), {y: 1 / s for y, s in share.items()}


SLOTS = len(ORDERS) << BITS
#: Tasks that hold the training sample; it is bounded, so they are too.
PARTS = 8


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 8_000, least: int = 3, smoothing: float = 100.0, steps: int = 20, l2: float = 1e-4) -> dict:
    rows, weight = sampled(docs, labels, sample_rows)
    none = np.zeros(SLOTS, np.float32)
    if not weight:
        return {"weights": none, "bias": -np.inf}
    held = saved(_held(rows.repartition(PARTS)))
    p, q, n1, n0 = _counts(held)
    if not n1 or not n0:
        return {"weights": none, "bias": np.inf if n1 else -np.inf}
    kept = np.flatnonzero(p + q >= least)
    a, b = smoothing * n1 / (n1 + n0), smoothing * n0 / (n1 + n0)
    ratio = np.log(((p[kept] + a) / (n1 + a)) / ((q[kept] + b) / (n0 + b)))
    c = {y: w / (n1 * weight.get(1, 0.0) + n0 * weight.get(0, 0.0)) for y, w in weight.items()}
    start = np.zeros(len(kept) + 1)  # the last is the bias
    start[-1] = np.log(n1 * weight[1] / (n0 * weight[0]))
    # the place of each slot among the kept ones is sent once, so that the vectors of a step are short
    place = np.full(SLOTS, len(kept), np.int32)
    place[kept] = np.arange(len(kept))
    del p, q
    shipped = docs.sparkSession.sparkContext.broadcast(place)
    w = minimised(lambda w: loss(held, shipped, ratio, c, l2, w), start, steps)
    shipped.destroy()
    none[kept] = w[:-1] * ratio
    return {"weights": none, "bias": float(w[-1])}


def _held(rows: DataFrame) -> DataFrame:
    """(y, f): label and slots of the training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, size=PIECE_BYTES):
            own: list[list[bytes]] = [[] for _ in texts]
            for of, slot in pairs(texts):
                for k, part in enumerate(np.split(slot, np.searchsorted(of, np.arange(1, len(texts))))):
                    own[k].append(part.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([b"".join(x) for x in own], pa.binary())], ["y", "f"])

    return rows.mapInArrow(run, "y int, f binary")


def _groups(batches: Iterator[pa.RecordBatch], size: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Labels, number of the row of each slot, slots: rows with about ``size`` slots at a time."""
    for batch in batches:
        labels, found = batch.column(0).to_numpy(), [np.frombuffer(f, np.uint32) for f in batch.column(1).to_pylist()]
        sizes = np.array([len(f) for f in found])
        ends = np.cumsum(sizes)
        at = 0
        while at < len(found):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield labels[at:to], np.repeat(np.arange(to - at), sizes[at:to]), np.concatenate(found[at:to])
            at = to


def _counts(held: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Training texts with each slot, and texts in all, by label: a row for each of the ``PARTS`` files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((2, SLOTS), np.int32), [0, 0]
        for y, of, slot in _groups(batches):
            for label in (0, 1):
                sums[label] += np.bincount(slot[y[of] == label], minlength=SLOTS).astype(np.int32)
                n[label] += int((y == label).sum())
        if any(n):
            yield pa.RecordBatch.from_arrays([pa.array([n[1]]), pa.array([n[0]]), pa.array([sums[1].tobytes()]), pa.array([sums[0].tobytes()])], ["n1", "n0", "p", "q"])

    p, q, n1, n0 = np.zeros(SLOTS), np.zeros(SLOTS), 0, 0
    for r in held.mapInArrow(run, "n1 long, n0 long, p binary, q binary").toLocalIterator():
        p, q, n1, n0 = p + np.frombuffer(r["p"], np.int32), q + np.frombuffer(r["q"], np.int32), n1 + r["n1"], n0 + r["n0"]
    return p, q, n1, n0


def loss(held: DataFrame, place, ratio: np.ndarray, c: dict[int, float], l2: float, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Weighted log loss with its gradient, added up over the tasks; ``place`` is a broadcast of the features of all slots."""
    size = len(ratio)
    # slots that are not kept have a feature of their own at the end, with weight 0
    shipped = held.sparkSession.sparkContext.broadcast((np.append(w[:-1] * ratio, 0).astype(np.float32), float(w[-1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (weights, bias), feature_of = shipped.value, place.value
        value, g, g_bias, some = 0.0, np.zeros(size + 1), 0.0, False
        for y, of, slot in _groups(batches):
            feature = feature_of[slot]
            z = np.bincount(of, weights[feature], len(y)) + bias
            signed = np.where(y == 1, z, -z)
            share = np.where(y == 1, c.get(1, 0.0), c.get(0, 0.0))
            value += float(share @ np.logaddexp(0, -signed))
            e = share * np.where(y == 1, -1.0, 1.0) / (1 + np.exp(np.clip(signed, -50, 50)))
            g += np.bincount(feature, e[of], size + 1)
            g_bias += float(e.sum())
            some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([value]), pa.array([g_bias]), pa.array([g[:-1].astype(np.float32).tobytes()])], ["value", "bias", "g"])

    value, g, g_bias = l2 / 2 * float(w[:-1] @ w[:-1]), np.zeros(size), 0.0
    for r in held.mapInArrow(run, "value double, bias double, g binary").collect():
        value, g_bias = value + r["value"], g_bias + r["bias"]
        g += np.frombuffer(r["g"], np.float32)
    shipped.destroy()
    held.sparkSession.sparkContext._jvm.System.gc()  # lets go of the vectors of the step
    return value, np.append(g * ratio + l2 * w[:-1], g_bias)


def minimised(f, w: np.ndarray, steps: int, memory: int = 4, least_gain: float = 1e-3) -> np.ndarray:
    """L-BFGS with halved steps; stops when a step gains less than this share of the value."""
    value, g = f(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, factors = -g, []
        for s, y, r in reversed(past):
            factors.append(r * (s @ d))
            d = d - factors[-1] * y
        d = d * (1 / (past[-1][2] * (past[-1][1] @ past[-1][1])) if past else 1 / max(1e-12, float(np.abs(g).sum())))
        for (s, y, r), k in zip(past, reversed(factors)):
            d = d + (k - r * (y @ d)) * s
        slope, t = float(g @ d), 1.0
        while True:
            after, g_after = f(w + t * d)
            if after <= value + 1e-4 * t * slope or t < 1e-3:
                break
            t /= 2
        if after > value:
            break
        s, y = t * d, g_after - g
        if s @ y > 1e-12:
            past = [*past, (s.astype(np.float32), y.astype(np.float32), 1 / float(s @ y))][-memory:]
        gain = value - after
        w, value, g = w + s, after, g_after
        if gain < least_gain * value:
            break
    return w


def score(docs: DataFrame, fitted: dict) -> DataFrame:
    """One row per document: doc_id, score."""
    shipped = docs.sparkSession.sparkContext.broadcast(fitted)
    df = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch, texts in slices(batches, size=PIECE_BYTES):
            z = sum((np.bincount(of, m["weights"][slot], len(texts)) for of, slot in pairs(texts)), np.full(len(texts), m["bias"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))), pa.float64())], ["doc_id", "score"])

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    rows = score(docs, fit(docs.filter(~held_out), labels.filter(~held_out)))
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
