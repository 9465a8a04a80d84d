"""Quality rules by line sequence labelling.

Every line with a word gets a few indicator features; a linear-chain conditional random
field labels the lines as content or boilerplate, decoded by Viterbi.  A text is kept
if lines labelled content hold at least ``min_share`` of its words, and if it passes
the base rules (50 words at least, at most half of them in repeated 3-word windows).

The field is trained here, on about ``sample_rows`` labelled rows at most (chosen by a hash of
the id), each whole; only the features and hashes of those lines reach the driver.  Labels are
of documents, so those of lines are found by expectation maximisation: at first the
lines of a document have its label, but for lines that stand in several documents between
different neighbours, which are boilerplate.  After each training the lines take the labels that the
field gives them, as long as most words of a document of good quality stay content and
most of a bad one boilerplate.  Half of the training sequences are spliced: a run of lines of a
document of the other kind is set among the lines, with its own labels, so that the
field learns where boilerplate begins and ends inside a text.

Without labels of both kinds every line is content.  Null texts have no words and are not kept.  A
line is a maximal run without a line feed; words are separated by the bytes 0x09-0x0D and
0x20.  Repeated rows are judged each for itself; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, slices, table

SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_MARKS = b"!?"

#: Lower ends of the buckets of each feature of a line.
BUCKETS = {"words": (2, 4, 8, 20, 60), "length": (3, 5, 7, 10), "symbols": (1, 5, 20), "upper": (10, 30, 60), "digits": (5, 20), "marks": (1, 5, 15), "repeats": (5, 20, 40, 60)}
_STARTS = dict(zip(BUCKETS, np.cumsum([0, *(len(b) + 1 for b in BUCKETS.values())]).tolist()))
_N = sum(len(b) + 1 for b in BUCKETS.values())
SEEN, ENDED, N_FEATURES = _N, _N + 1, _N + 2


def features(line: bytes, w: list[bytes], seen: bool) -> list[int]:
    """Indexes of the indicators that hold for a line with the words ``w``."""
    n, size = len(w), len(line)
    share = lambda drop: 100 * (size - len(line.translate(None, drop))) // size
    values = (n, sum(map(len, w)) // n, share(SYMBOLS), share(_UPPER), share(_DIGITS), share(_MARKS), 100 * (n - len(set(w))) // n)
    out = []
    for (name, ends), v in zip(BUCKETS.items(), values):
        out.append(_STARTS[name] + sum(v >= e for e in ends))
    if seen:
        out.append(SEEN)
    if line.rstrip(SPACES)[-1:] in b".!?:;":
        out.append(ENDED)
    return out


def lines(text: bytes) -> tuple[list[list[int]], list[int], int]:
    """Features and numbers of words of the lines with a word; lines equal to an earlier one."""
    seen: set[bytes] = set()
    found, sizes, again = [], [], 0
    for line in text.split(b"\n"):
        if w := line.split():
            old = line in seen
            again += old
            seen.add(line)
            found.append(features(line, w, old))
            sizes.append(len(w))
    return found, sizes, again


def repeated_words(w: list[bytes]) -> int:
    """Words in 3-word windows that are found twice or more."""
    windows = list(zip(w, w[1:], w[2:]))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    covered, upto = 0, 0
    for k, window in enumerate(windows):
        if count[window] > 1:
            covered += k + 3 - max(k, upto)
            upto = k + 3
    return covered


class Field:
    """Linear-chain field with labels 0 (boilerplate) and 1 (content)."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move  # (features, 2), (2, 2)
        self.gain = (emit[:, 1] - emit[:, 0]).tolist()

    def viterbi(self, found: list[list[int]]) -> list[int]:
        """The best label sequence; content wins ties."""
        (a00, a01), (a10, a11) = self.move.tolist()
        s0, s1, back = 0.0, 0.0, []
        for k, f in enumerate(found):
            g = sum(map(self.gain.__getitem__, f))
            if k:
                b0, b1 = s1 + a10 >= s0 + a00, s1 + a11 >= s0 + a01
                s0, s1 = (s1 + a10 if b0 else s0 + a00), (s1 + a11 if b1 else s0 + a01)
                back.append((b0, b1))
            s1 += g
        label, out = int(s1 >= s0), []
        for step in reversed(back):
            out.append(label)
            label = int(step[label])
        return [*out, label][::-1] if found else []


#: A line is boilerplate at first if it stands between so many different neighbours.
CONTEXTS = 5
Doc = tuple[int, list[list[int]], list[int], list[int]]  # label, features, words and hashes of the lines


def first_labels(docs: list[Doc]) -> list[list[int]]:
    """The document's label for its lines, but 0 for lines that recur between different neighbours."""
    around: dict[int, set] = {}
    for _, _, _, hashes in docs:
        for k, h in enumerate(hashes):
            seen = around.setdefault(h, set())
            if len(seen) < CONTEXTS:
                seen.add((hashes[k - 1] if k else None, hashes[k + 1] if k + 1 < len(hashes) else None))
    return [[0 if len(around[h]) >= CONTEXTS else y for h in hashes] for y, _, _, hashes in docs]


def within_bag(doc: Doc, new: list[int], old: list[int]) -> list[int]:
    """The new labels if most words then still have the label of the document, else the old ones."""
    y, _, words, _ = doc
    own = sum(n for n, label in zip(words, new) if label == y)
    return new if 2 * own > sum(words) else old


def spliced(docs: list[Doc], labels: list[list[int]], seed: int = 0) -> list[tuple[int, list[int], list[list[int]]]]:
    """Training sequences (label of the document, labels of the lines, features): every other one holds a run of lines of the other kind."""
    r = np.random.default_rng(seed)
    by_kind = [[k for k, d in enumerate(docs) if d[0] == y] for y in (0, 1)]
    out = []
    for k, (y, found, _, _) in enumerate(docs):
        own, other = labels[k], by_kind[1 - y]
        if k % 2 and other:
            give = int(other[r.integers(len(other))])
            size = int(min(r.geometric(0.4), len(docs[give][1])))
            start, at = int(r.integers(len(docs[give][1]) - size + 1)), int(r.integers(len(own) + 1))
            own = own[:at] + labels[give][start : start + size] + own[at:]
            found = found[:at] + docs[give][1][start : start + size] + found[at:]
        out.append((y, own, found))
    return out


def trained(docs: list[Doc], rounds: int = 3) -> Field:
    """Alternates training on the labels of the lines and labelling the lines by the field."""
    docs = [d for d in docs if d[1]]
    if {d[0] for d in docs} != {0, 1}:
        return Field(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)))
    first = labels = first_labels(docs)
    field = None
    for k in range(rounds):
        field = maximised(spliced(docs, labels, k), field)
        labels = [within_bag(d, field.viterbi(d[1]), old) for d, old in zip(docs, first)]
    return field


def maximised(chains: list[tuple[int, list[int], list[list[int]]]], start: Field | None, steps: int = 120, l2: float = 1e-4) -> Field:
    """Maximum likelihood by gradient ascent over all chains at once (forward and backward by position)."""
    chains = sorted(chains, key=lambda d: -len(d[2]))
    every_size = np.array([len(f) for _, _, f in chains])
    y_all = np.array([d[0] for d in chains])
    weights = np.where(y_all == 1, 0.5 / (y_all == 1).sum(), 0.5 / (y_all == 0).sum())
    weights /= (weights * every_size).sum()
    groups = []  # chains of similar length, so that padding at most doubles them
    at = 0
    while at < len(chains):
        to = int(np.searchsorted(-every_size, -(every_size[at] // 2), "left"))
        to = max(to, at + 1)
        some, size = chains[at:to], every_size[at:to]
        n, longest = len(some), int(size[0])
        cell = np.array([i * n + k for k, (_, _, found) in enumerate(some) for i, f in enumerate(found) for _ in f], np.int64)
        feature = np.array([v for _, _, found in some for f in found for v in f], np.int64)
        y = np.zeros((longest, n), np.int8)
        for k, (_, own, _) in enumerate(some):
            y[: len(own), k] = own
        groups.append((n, longest, size, y, weights[at:to], cell, feature))
        at = to
    emit, move = (np.zeros((N_FEATURES, 2)), np.zeros((2, 2))) if start is None else (start.emit.copy(), start.move.copy())
    m_emit, m_move = np.zeros_like(emit), np.zeros_like(move)
    for _ in range(steps):
        g_emit, g_move = -l2 * emit, -l2 * move
        for group in groups:
            add_emit, add_move = _gradient(emit, move, *group)
            g_emit, g_move = g_emit + add_emit, g_move + add_move
        m_emit, m_move = 0.9 * m_emit + g_emit, 0.9 * m_move + g_move
        emit, move = emit + m_emit, move + 0.3 * m_move
    return Field(emit, move)


def _gradient(emit, move, n, longest, size, y, c, cell, feature) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of chains with labels ``y`` by position, padded to the longest; ``cell`` is the place of each ``feature``."""
    live = np.arange(longest)[:, None] < size[None]
    e = np.stack([np.bincount(cell, emit[feature, k], longest * n) for k in range(2)], 1).reshape(longest, n, 2)
    alpha = np.zeros((longest, n, 2))
    beta = np.zeros((longest, n, 2))
    alpha[0] = e[0]
    for i in range(1, longest):
        alpha[i] = np.logaddexp(alpha[i - 1, :, :1] + move[0], alpha[i - 1, :, 1:] + move[1]) + e[i]
    for i in range(longest - 2, -1, -1):
        after = beta[i + 1] + e[i + 1]
        beta[i] = np.where(live[i + 1][:, None], np.logaddexp(after[:, :1] + move[:, 0], after[:, 1:] + move[:, 1]), 0)
    z = np.logaddexp(*alpha[size - 1, np.arange(n)].T)
    gamma = np.exp(np.minimum(alpha + beta - z[None, :, None], 0)) * live[..., None]
    truth = np.stack([1 - y, y], -1) * live[..., None]
    rest = ((truth - gamma) * c[None, :, None]).reshape(-1, 2)
    g_emit = np.stack([np.bincount(feature, rest[cell, k], N_FEATURES) for k in range(2)], 1)
    pair = alpha[:-1, :, :, None] + move + (e + beta)[1:, :, None, :] - z[None, :, None, None]
    pair = np.exp(np.minimum(pair, 0)) * live[1:, :, None, None]
    both = truth[:-1, :, :, None] * truth[1:, :, None, :]
    return g_emit, np.einsum("inlm,n->lm", both - pair, c)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 3_000) -> Field:
    known = labels.filter("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("y")).filter("y IN (0, 1)")
    totals = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    below = F.lit(0)
    for y, n in totals.items():
        below = F.when(F.col("y") == y, F.lit(int(min(1.0, sample_rows / 2 / n) * (1 << 20)))).otherwise(below)
    some = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < below)
    # about sample_rows pairs of numbers: bounded, so sent to all
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            each = [lines(t) if t else ([], [], 0) for t in texts]
            hashes = [[xxhash.xxh64_intdigest(line.strip(SPACES)) >> 1 for line in t.split(b"\n") if line.split()] if t else [] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([e[0] for e in each], pa.list_(pa.list_(pa.int32()))), pa.array([e[1] for e in each], pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64()))], ["y", "f", "n", "h"])

    got = rows.mapInArrow(run, "y int, f array<array<int>>, n array<int>, h array<long>").filter(F.size("f") > 0).toArrow().to_pylist()
    got.sort(key=lambda r: (r["h"], r["y"]))  # the same order whatever the tasks were
    return trained([(r["y"], r["f"], r["n"], r["h"]) for r in got])


def judge(text: bytes | None, field: Field, min_share: float) -> tuple:
    text = text or b""
    w = text.split()
    found, sizes, again = lines(text)
    packed = len(text.translate(None, SPACES))
    chars = len(text.translate(None, SPACES).decode(errors="replace")) if packed else 0
    repeats = repeated_words(w)
    labels = field.viterbi(found)
    content = sum(n for n, label in zip(sizes, labels) if label)
    failed = len(w) < 50 or 100 * repeats > 50 * len(w)
    share = content / len(w) if w else 0.0
    return len(w), chars, len(text) - len(text.translate(None, SYMBOLS)), again, repeats, failed, not failed and share >= min_share, share, labels


def label(docs: DataFrame, field: Field, min_share: float = 0.5) -> DataFrame:
    """One row per document: the base figures, kept, content_share and the labels of its lines with a word."""
    shipped = docs.sparkSession.sparkContext.broadcast(field)
    df = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share", "line_labels"]
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64(), pa.list_(pa.int8())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            rows = list(zip(*(judge(t, shipped.value, min_share) for t in texts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(v), k) for v, k in zip(rows, kinds))], ["doc_id", *names])

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names[:5]) + ", base_failed boolean, kept boolean, content_share double, line_labels array<byte>")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = label(docs, fit(docs, table(spark, sf_dir, "labels")))
    return rows.drop("line_labels")
