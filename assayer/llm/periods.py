"""Runs of repeated word sequences (maximal repetitions) by block convolution.

A run is a stretch of consecutive words with smallest period q, of at least ``least`` words
and two periods, that no neighbouring word extends with that period.

Seeds.  At scale B (2, 4, 8, ...) the words are cut into blocks of B, and each block is looked up at the
distances 2B-1 to 4B-2 after it (1 to 6 at the first scale).  A run of period q has at least
max(q, least - q) places whose word is the same q words later, and a stretch of
2B-1 such places holds a whole block, so every run has a block that occurs again at distance q.
For codes x of a block and y of what follows, the sum of (x - y)^2 at every
distance is sum x^2 + sum y^2 - 2 sum xy; the last sum is a number-theoretic transform
modulo 15 * 2^27 + 1.  Codes are word numbers modulo a bound that keeps the sum of squares below that
prime, so the sums are exact, and a distance with sum zero is a seed.  A block with a word that has no
other occurrence within the distances has no seed; such blocks are left out before the transform.

Extensions.  Seeds go from the smallest distance up.  A seed that lies in a known run whose period divides its distance
belongs to that run; any other is compared word by word in both directions to the
maximal stretch with that distance as period, which also settles codes that met by chance.  By
Fine and Wilf, a stretch of two distances whose smallest period is less has one that divides the distance,
and that run is known before; so the distance is the smallest period of what is left.

Texts are whole and never meet: a slice of texts is handled as one array with borders.  Null, empty and blank texts have no
words and no runs.  Repeated rows are handled each for itself.  An empty table gives no
rows.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import cache
from hashlib import sha256
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, table, two_columns

PRIME, ROOT, LONGEST = 15 * (1 << 27) + 1, 31, 1 << 27
_P = np.uint64(PRIME)
#: Numbers in one array of a transform.
CELLS = 1 << 18
#: Bytes of text whose words a task holds at one time.
TEXT_BYTES = 4 << 20


@cache
def _powers(n: int, inverse: bool) -> np.ndarray:
    """The first n / 2 powers of an n-th root of unity."""
    w = pow(ROOT, (PRIME - 1) // n, PRIME)
    w = pow(w, -1, PRIME) if inverse else w
    out = np.ones(1, np.uint64)
    while len(out) < max(n // 2, 1):
        out = np.concatenate([out, out * np.uint64(pow(w, len(out), PRIME)) % _P])
    return out


def forward(x: np.ndarray) -> np.ndarray:
    """Transform of every column of x (length a power of two by columns), in bit-reversed order; x is overwritten."""
    n, columns = x.shape
    powers, m = _powers(n, False), n // 2
    while m:
        y = x.reshape(n // (2 * m), 2, m, columns)
        u, v = y[:, 0], y[:, 1]
        rest = (u + (_P - v)) * powers[:: n // (2 * m)][:m, None] % _P
        u += v
        np.minimum(u, u - _P, out=u)
        v[...] = rest
        m //= 2
    return x


def backward(x: np.ndarray) -> np.ndarray:
    """The inverse of ``forward``, without the factor 1 / n; x is overwritten."""
    n, columns = x.shape
    powers, m = _powers(n, True), 1
    while m < n:
        y = x.reshape(n // (2 * m), 2, m, columns)
        u, v = y[:, 0], y[:, 1]
        v *= powers[:: n // (2 * m)][:m, None]
        v %= _P
        rest = u + (_P - v)
        u += v
        np.minimum(u, u - _P, out=u)
        np.minimum(rest, rest - _P, out=v)
        m *= 2
    return x


def mismatches(blocks: np.ndarray, windows: np.ndarray, distances: int) -> np.ndarray:
    """Sums of squared differences of each block (a column) with the piece of its window at 0, 1, ... ``distances`` - 1.

    Exact if every sum is less than PRIME.
    """
    b, n = len(blocks), 1
    while n < len(windows):
        n *= 2
    if n > LONGEST:
        raise ValueError("window too long for the transform's modulus")
    x, y = np.zeros((n, blocks.shape[1]), np.uint64), np.zeros((n, blocks.shape[1]), np.uint64)
    x[0], x[n - b + 1 :] = blocks[0], blocks[:0:-1]
    y[: len(windows)] = windows
    products = forward(x)
    products *= forward(y)
    products %= _P
    products = backward(products)[:distances]
    products *= np.uint64(2 * pow(n, -1, PRIME) % PRIME)
    products %= _P
    squares = np.zeros((len(windows) + 1, windows.shape[1]), np.uint64)
    np.cumsum(windows * windows, axis=0, out=squares[1:])
    sums = squares[b : b + distances] - squares[:distances] + (blocks * blocks).sum(0)
    return (sums + (_P - products)) % _P


def scales(longest: int) -> Iterator[tuple[int, int, int]]:
    """(block, least distance, greatest distance) up to half of the longest text."""
    block, low = 2, 1
    while 2 * low <= longest:
        yield block, low, 4 * block - 2
        low, block = 4 * block - 1, 2 * block


class Words:
    """The words of several texts as one array of numbers; equal numbers are equal words of one text."""

    def __init__(self, texts: list[list[bytes]]):
        ids, self.starts, known = [], [0], 0
        for words in texts:
            index = dict(zip(dict.fromkeys(words), count(known)))
            ids.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
            known += len(index)
            self.starts.append(self.starts[-1] + len(words))
        self.ids = np.concatenate([np.zeros(0, np.int64), *ids])
        self.starts = np.array(self.starts)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.starts))
        self.end = self.starts[1:][self.doc]
        # places by word: sorted keys word * n + place, and the distance to the next place of the same word
        n = len(self.ids)
        order = np.argsort(self.ids, kind="stable")
        self.keys = self.ids[order] * n + order
        again = np.diff(self.ids[order]) == 0
        self.next = np.full(n, n + 1)
        self.next[order[:-1][again]] = np.diff(order)[again]

    def within(self, places: np.ndarray, low: int, high: int) -> np.ndarray:
        """Whether the word of a place occurs again at a distance from low to high."""
        base = self.ids[places] * len(self.ids) + places
        at = np.searchsorted(self.keys, base + low)
        found = self.keys[np.minimum(at, len(self.keys) - 1)]
        # keys of one word are less than n apart, and words of other texts have other numbers
        return (at < len(self.keys)) & (found <= base + high) & (found // len(self.ids) == self.ids[places])

    def seeds(self, block: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, distance) of every block and distance without a mismatch of codes."""
        n = len(self.ids)
        starts = np.arange(0, n - block + 1, block)
        starts = starts[self.next[: len(starts) * block].reshape(-1, block).max(1, initial=0) <= high] if len(starts) else starts
        starts = starts[starts + block + low <= self.end[starts]]
        starts = starts[self.doc[starts] == self.doc[starts + block - 1]]
        for step in (block - 1, 0, block // 2):  # some words first, as one word without a partner settles a block
            starts = starts[self.within(starts + step, low, high)]
        at = max(1, (1 << 20) // block)
        starts = np.concatenate([starts[:0], *(s[self.within((s[:, None] + np.arange(block)).ravel(), low, high).reshape(-1, block).all(1)] for s in np.split(starts, range(at, len(starts), at)))])
        distances = high - low + 1
        bound = int(((PRIME - 1) // block) ** 0.5) - 1
        place, distance = [starts[:0]], [starts[:0]]
        each = max(1, CELLS // (4 * block))
        for k in range(0, len(starts), each):
            s = starts[k : k + each]
            codes = self._codes(s, block, bound)
            windows = self._codes(s + low, distances + block - 1, bound)
            windows[s + low + np.arange(distances + block - 1)[:, None] >= self.end[s]] = bound  # no word has this code
            d, column = np.nonzero(mismatches(codes, windows, distances) == 0)
            place.append(s[column])
            distance.append(d + low)
        return np.concatenate(place), np.concatenate(distance)

    def _codes(self, starts: np.ndarray, length: int, bound: int) -> np.ndarray:
        places = np.minimum(starts + np.arange(length)[:, None], len(self.ids) - 1)
        return (self.ids[places] % bound).astype(np.uint64)

    def same(self, place: int, distance: int, limit: int, step: int) -> int:
        """How many places from ``place`` on (step 1), or before it (step -1), have the same word ``distance`` later."""
        ids, done, size = self.ids, 0, 64
        while done < limit:
            k = min(size, limit - done)
            a = place + done if step > 0 else place - done - k
            differ = ids[a : a + k] != ids[a + distance : a + distance + k]
            if differ.any():
                return done + int(np.argmax(differ) if step > 0 else np.argmax(differ[::-1]))
            done, size = done + k, 2 * size
        return done

    def runs(self, least: int = 12) -> list[list[tuple[int, int, int]]]:
        """For each text its runs (start, length, period), by start, then period."""
        found: list[dict[int, list[tuple[int, int]]]] = [{} for _ in self.starts[1:]]
        longest = int(np.diff(self.starts).max(initial=0))
        for block, low, high in scales(longest):
            place, distance = self.seeds(block, low, high)
            order = np.lexsort((place, distance, self.doc[place]))
            place, distance = place[order], distance[order]
            docs, first = np.unique(self.doc[place], return_index=True)
            for k, s, d in zip(docs.tolist(), np.split(place, first[1:]), np.split(distance, first[1:])):
                self._extended(found[k], s, d, block, int(self.starts[k]), int(self.starts[k + 1]), least)
        return [sorted((a - int(start), e - a, q) for q, some in of.items() for a, e in some) for of, start in zip(found, self.starts)]

    def _extended(self, known: dict[int, list[tuple[int, int]]], place: np.ndarray, distance: np.ndarray, block: int, start: int, end: int, least: int) -> None:
        """Adds the runs of one text that seeds of one scale, ordered by distance and place, lead to."""
        for q, some in known.items():
            kept = ~_covered(some, q, place, distance)
            place, distance = place[kept], distance[kept]
        values, first = np.unique(distance, return_index=True)
        for d, s in zip(values.tolist(), np.split(place, first[1:])):
            for q in [q for q in known if q < d and d % q == 0]:
                s = s[~_covered(known[q], q, s, np.full(len(s), d))]
            new, k = [], 0
            while k < len(s):
                at = int(s[k])
                after = self.same(at, d, end - d - at, 1)
                if after < block:  # different words with equal codes
                    k += 1
                    continue
                a, e = at - self.same(at, d, at - start, -1), at + after + d
                if e - a >= max(least, 2 * d):
                    new.append((a, e))
                k = int(np.searchsorted(s, at + after, "right"))
            if new:
                known[d] = new


def _covered(runs: list[tuple[int, int]], period: int, place: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Seeds inside a run whose period divides their distance; runs of one period are ordered by start and by end."""
    a, e = np.array(runs).T
    at = np.searchsorted(a, place, "right") - 1
    return (distance % period == 0) & (at >= 0) & (place + distance < e[at])


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run has after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return list(compress(words, (np.cumsum(edges)[:-1] == 0).tolist()))


def best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The longest run; of those the first, then the one with the smallest period."""
    return min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)


Rewrite = Callable[[object, list[bytes]], list[bytes]]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12, rewrite: Rewrite | None = None) -> DataFrame:
    """doc_id, runs (structs start, length, period, by start and period), best (of these, or null) and collapsed.

    Words are what stands between the bytes 0x09-0x0D and 0x20; ``collapsed`` has the
    kept words with one space between.  ``rewrite`` may change the words of a row first, given its id.
    """
    df = two_columns(docs, id_col, text_col)
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, size=TEXT_BYTES):
            words = [t.split() if t else [] for t in texts]
            if rewrite:
                words = [rewrite(i, w) for i, w in zip(batch.column(0).to_pylist(), words)]
            runs = Words(words).runs(least)
            named = [[dict(zip(("start", "length", "period"), r)) for r in some] for some in runs]
            top = [dict(zip(("start", "length", "period"), r)) if (r := best(some)) else None for some in runs]
            short = [b" ".join(collapsed(w, some)) for w, some in zip(words, runs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(named, pa.list_(run_type)), pa.array(top, run_type), pa.array(short, pa.binary()).cast(pa.string())], ["doc_id", "runs", "best", "collapsed"])

    one = "struct<start: long, length: long, period: long>"
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, runs array<{one}>, best {one}, collapsed string")


def spliced(doc_id, words: list[bytes]) -> list[bytes]:
    """The words of a tenth of the rows, by crc32 of the id, with a repetition up to the end; a null id has none."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def query(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = periodic_runs(table(spark, sf_dir, "documents"), rewrite=spliced)
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    top = F.col("best")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), top["start"].alias("start"), top["length"].alias("length"), top["period"].alias("period"),
        F.floor(F.lit(1000) * top["length"] / top["period"]).alias("exponent_milli"), F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
