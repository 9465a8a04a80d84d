"""Language-model scoring with a hidden Markov model.

Tokens are words (A-Z in lower case, separated by the bytes 0x09-0x0D and 0x20), then
one end.  The model emits symbols: each of the ``frequent`` most frequent training
tokens is a symbol of its own, every other word belongs to one of ``RARE`` symbols by its
ending; a rare word then has the probability (c + 1) / (N_r + V_r + 1) within its
symbol, with the counts of the training words of that symbol.  The probabilities of all known
words and one unknown word of each symbol sum to one.

Training.  Baum-Welch: every task adds up the expected counts of its documents, Spark
adds up the tasks', and the driver normalises: its tables have states x symbols
cells, whatever the input.  Every round covers all training documents, at every size of input,
with exact messages over whole documents; rounds end when one gains less than ``gain`` of the
log likelihood, or after ``rounds``.  The expected counts of a task are taken in single precision
and added up in double; the score is the exact forward recursion in double precision, scaled
at every token, over the whole document.

Counts of rare words never leave Spark: they are joined by word and added up by document.

A null text counts as empty: it has the end alone.  Repeated rows are separate
documents; a null id belongs to the training rows.  Without training tokens, N and V are 0.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, held, saved, slices, table

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
RARE = 64
#: Tokens whose messages are held at one time, about; a longer sequence is one group.
TOKENS = 1 << 20
#: How far the first emissions of the states lie apart.
SPREAD = 0.7
END = ""


def tokens(text: bytes | None) -> list[bytes]:
    return text.translate(_LOWER).split() if text else []


def ending(word: bytes) -> int:
    """The symbol of a rare word among ``RARE``: from its last two bytes."""
    return (word[-1] * 31 + (word[-2] if len(word) > 1 else 0)) % RARE


def counts(train: DataFrame) -> DataFrame:
    """(word, rare, c) of all training tokens; the end is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def told():
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array([ending(w) if w else -1 for w in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["word", "rare", "c"])
            seen.clear()
            for at in range(0, batch.num_rows, 20_000):
                yield batch.slice(at, 20_000)

        for _, texts in slices(batches):
            for t in texts:
                seen.update(tokens(t))
                seen[b""] += 1
            if len(seen) > 600_000:
                yield from told()
        yield from told()

    return train.select("text").mapInArrow(run, "word string, rare int, c long").groupBy("word", "rare").agg(F.sum("c").alias("c"))


class Symbols:
    """Numbers of symbols by word: frequent words first, then the rare endings."""

    def __init__(self, words: list[str], c: list[int]):
        self.of = {w.encode(): k for k, w in enumerate(words)}
        self.c = np.array(c, np.int64)
        self.end = self.of.get(b"", len(words))
        self.first_rare = len(words) + 1
        self.size = self.first_rare + RARE

    def encode(self, w: list[bytes]) -> tuple[np.ndarray, Counter]:
        get = self.of.get
        ids = [get(x, -1) for x in w]
        rare: Counter = Counter()
        if -1 in ids:
            for k, i in enumerate(ids):
                if i < 0:
                    ids[k] = self.first_rare + ending(w[k])
                    rare[w[k]] += 1
        ids.append(self.end)
        return np.array(ids, np.uint16), rare


def encoded(docs: DataFrame, words: list[str], c: list[int]) -> DataFrame:
    """(doc_id, held_out, symbols, rare): symbols as packed 16-bit integers, rare words with their number."""
    shipped = docs.sparkSession.sparkContext.broadcast((words, c))
    key = shipped._jbroadcast.id()
    pairs = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = held(("symbols", key), lambda: Symbols(*shipped.value))
        for batch, texts in slices(batches):
            both = [symbols.encode(tokens(t)) for t in texts]
            sizes = np.cumsum([0, *(len(r) for _, r in both)])
            flat_w = [w for _, r in both for w in r]
            flat_n = [n for _, r in both for n in r.values()]
            items = pa.StructArray.from_arrays([pa.array(flat_w, pa.binary()).cast(pa.string()), pa.array(flat_n, pa.int32())], fields=list(pairs.value_type))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s.tobytes() for s, _ in both], pa.binary()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), items)], ["doc_id", "held_out", "symbols", "rare"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, symbols binary, rare array<struct<word:string,n:int>>")


def _groups(rows: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Sequences (shortest first) in groups of about ``TOKENS`` tokens of similar length, longest first in each."""
    some, size = [], 0
    for s in rows:
        if some and size + len(s) > TOKENS:
            yield some[::-1]
            some, size = [], 0
        some.append(s)
        size += len(s)
    if some:
        yield some[::-1]


class Model:
    """start (states), move (states, states), emit (symbols, states)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, states: int, weight: np.ndarray) -> Model:
        r = np.random.default_rng(0)
        emit = weight[:, None] * np.exp(r.normal(0, SPREAD, (len(weight), states)))
        move = 0.95 * np.eye(states) + 0.05 / states  # states last, as a text has one language
        return cls(np.full(states, 1 / states), move, emit / emit.sum(0))

    @classmethod
    def normalised(cls, start, move, emit, weight: np.ndarray) -> Model:
        """From expected counts, each smoothed by one count spread as the corpus is."""
        emit = emit + 20 * weight[:, None]
        move, start = move + 0.1, start + 0.1
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def expected(self, rows: list[np.ndarray], kind=np.float64) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts of whole sequences, many at once, and their log likelihood; messages have the given precision."""
        k = len(self.start)
        own_start, own_move, own_emit = (x.astype(kind) for x in (self.start, self.move, self.emit))
        start, move, emit, total = np.zeros(k), np.zeros((k, k)), np.zeros_like(self.emit), 0.0
        rows = sorted((s for s in rows if len(s)), key=len)
        one = np.ones(k, kind)
        for some in _groups(rows):
            # tokens stand by their place in the sequence, longest sequence first
            size = np.array([len(s) for s in some])
            t = int(size[0])
            live = len(some) - np.searchsorted(size[::-1], np.arange(t), "right")
            off = np.cumsum(live) - live
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            sym = np.empty(len(place), np.int64)
            sym[off[place] + np.repeat(np.arange(len(some)), size)] = np.concatenate(some)
            b, scale = own_emit[sym], np.empty(len(sym), kind)
            alpha = np.empty_like(b)
            live, off = live.tolist(), off.tolist()
            before = 0
            for o, n in zip(off, live):
                a = alpha[o : o + n]
                if o:
                    np.matmul(alpha[before : before + n], own_move, out=a)
                    a *= b[o : o + n]
                else:
                    np.multiply(own_start, b[:n], out=a)
                z = np.matmul(a, one, out=scale[o : o + n])
                a /= z[:, None]
                before = o
            total += float(np.log(scale).sum(dtype=np.float64))
            b /= scale[:, None]
            beta, back_move = np.ones((len(some), k), kind), np.ascontiguousarray(own_move.T)
            pairs = np.zeros((k, k))
            for i in range(t - 1, -1, -1):
                o, n = off[i], live[i]
                now = beta[:n]
                alpha[o : o + n] *= now
                if i:
                    back = b[o : o + n]
                    back *= now
                    pairs += alpha[off[i - 1] : off[i - 1] + n].T @ back
                    np.matmul(back, back_move, out=now)
            move += pairs * self.move
            start += alpha[: live[0]].sum(0, dtype=np.float64)
            for s in range(k):
                emit[:, s] += np.bincount(sym, alpha[:, s], len(emit))
        return start, move, emit, total

    def log10(self, rows: list[np.ndarray]) -> np.ndarray:
        """Exact log10 likelihood of whole sequences: the scaled forward recursion, many at once."""
        out = np.zeros(len(rows))
        order = sorted(range(len(rows)), key=lambda r: -len(rows[r]))
        for at in range(0, len(order), 512):
            some = order[at : at + 512]
            size = np.array([len(rows[r]) for r in some])
            if not size[0]:
                break
            flat = np.concatenate([rows[r] for r in some]).astype(np.int64)
            begins = np.cumsum(size) - size
            total = np.zeros(len(some))
            a = np.tile(self.start, (len(some), 1))
            n = len(some)
            for i in range(int(size[0])):
                while size[n - 1] <= i:
                    n -= 1
                a = (a[:n] @ self.move if i else a[:n]) * self.emit[flat[begins[:n] + i]]
                z = a.sum(1)
                total[:n] += np.log10(z)
                a /= z[:, None]
            out[some] = total
        return out


#: Symbols whose counts travel in one row.
BLOCK = 2048


def baum_welch(sequences: DataFrame, model: Model, weight: np.ndarray) -> tuple[Model, float]:
    """One round over all rows of ``sequences`` (symbols): rows of packed counts for each task, added up by block."""
    spark = sequences.sparkSession
    shipped = spark.sparkContext.broadcast(model)
    k = len(model.start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, sums = shipped.value, None
        for batch in batches:
            rows = [np.frombuffer(s, np.uint16) for s in batch.column(0).to_pylist()]
            new = m.expected(rows, np.float32)
            sums = new if sums is None else tuple(a + b for a, b in zip(sums, new))
        if sums is not None:
            start, move, emit, total = sums
            blocks = [b for b in range(0, len(emit), BLOCK) if emit[b : b + BLOCK].any()]
            packed = [np.concatenate([start, move.ravel(), [total]]).tobytes(), *(emit[b : b + BLOCK].astype(np.float32).tobytes() for b in blocks)]
            yield pa.RecordBatch.from_arrays([pa.array([-1, *blocks], pa.int32()), pa.array(packed, pa.binary())], ["block", "v"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        told = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "v"])
        for batch in batches:
            for block, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.frombuffer(v, np.float64 if block < 0 else np.float32).astype(np.float64)
                if block != now:
                    if now is not None:
                        yield told()
                    now, total = block, values
                else:
                    total = total + values
        if now is not None:
            yield told()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = sequences.select("symbols").mapInArrow(run, "block int, v binary")
    rows = each.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(added, "block int, v binary").collect()  # the tables of the model
    if not rows:
        return model, 0.0
    emit = np.zeros_like(model.emit)
    for r in rows:
        values = np.frombuffer(r["v"], np.float64)
        if r["block"] < 0:
            start, move, total = values[:k], values[k : k + k * k].reshape(k, k), float(values[-1])
        else:
            emit[r["block"] : r["block"] + BLOCK] = values.reshape(-1, k)
    return Model.normalised(start, move, emit, weight), total


def score(docs: DataFrame, held_out, frequent: int = 60_000, states: int = 8, rounds: int = 14, gain: float = 1e-3) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` is a condition on doc_id; the model learns from the other rows.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    c = saved(counts(rows.filter("NOT held_out")))
    whole = c.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    total, distinct = int(whole["n"] or 0), int(whole["v"])
    top = c.orderBy(F.desc("c"), "word").limit(frequent).toPandas()  # bounded by ``frequent``
    words, top_c = top["word"].tolist(), [int(x) for x in top["c"]]
    least = (top_c[-1], words[-1]) if len(words) >= frequent else (0, "")  # the last frequent word
    if END not in words and total:
        words.append(END)
        top_c.append(int(c.filter("word = ''").first()["c"]))
    symbols = Symbols(words, top_c)
    tail = c.groupBy("rare").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    rare_n, rare_v = np.zeros(RARE, np.int64), np.zeros(RARE, np.int64)
    for r in tail:
        if r["rare"] >= 0:
            rare_n[r["rare"]], rare_v[r["rare"]] = r["c"], r["v"]
    for w, n in zip(words, top_c):
        if w:
            rare_n[ending(w.encode())] -= n
            rare_v[ending(w.encode())] -= 1
    weight = np.concatenate([symbols.c, np.zeros(symbols.first_rare - len(words)), rare_n]) + 0.5
    weight = weight / weight.sum()

    # sorted by length, so that a task's sequences of similar length stand together
    known = saved(encoded(rows, words, top_c).withColumn("row", F.monotonically_increasing_id()).sortWithinPartitions(F.octet_length("symbols")))
    train = known.filter("NOT held_out")
    model, before = Model.first(states, weight), -math.inf
    for _ in range(rounds if total else 0):
        model, likelihood = baum_welch(train, model, weight)
        spark.sparkContext._jvm.System.gc()  # lets Spark delete the round's shuffle files
        if likelihood - before < -gain * likelihood:
            break
        before = likelihood

    # rare words: counts come by word, sums go back by document
    pairs = known.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.n").alias("tf"))
    tail_c = c.filter((F.col("c") < least[0]) | ((F.col("c") == least[0]) & (F.col("word") > least[1]))).select("word", "c")
    sums = pairs.join(tail_c, "word").groupBy("row").agg(F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("rare_log"), F.sum(F.col("tf").cast("long")).alias("rare_known"))

    shipped = docs.sparkSession.sparkContext.broadcast(model)
    log_c = np.log10(np.concatenate([symbols.c, np.zeros(symbols.size - len(words))]) + 1)
    within = np.zeros(symbols.size)
    within[symbols.first_rare :] = np.log10(rare_n + rare_v + 1)
    seen = np.concatenate([symbols.c > 0, np.zeros(symbols.size - len(words), bool)])
    tables = docs.sparkSession.sparkContext.broadcast((log_c, within, seen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, (by_c, by_symbol, is_known) = shipped.value, tables.value
        for batch in batches:
            seqs = [np.frombuffer(s, np.uint16) for s in batch.column(3).to_pylist()]
            for at in range(0, len(seqs), 2048):
                some = seqs[at : at + 2048]
                figures = [pa.array([len(s) for s in some], pa.int64()), pa.array([int(is_known[s].sum()) for s in some], pa.int64()), pa.array([float(by_c[s].sum()) for s in some]), pa.array(m.log10(some) - np.array([by_symbol[s].sum() for s in some]))]
                part = batch.slice(at, len(some))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *figures], ["row", "doc_id", "held_out", "n_tokens", "known", "base_log", "hmm"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    own = known.select("row", "doc_id", "held_out", "symbols").mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base_log double, hmm double")
    rare = F.coalesce("rare_log", F.lit(0.0))
    return own.join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_log") + rare - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1))).alias("base_score"),
        (F.col("hmm") + rare).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) == 2)

