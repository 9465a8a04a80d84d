"""Language identification by word-first backoff.

A word seen in training is scored by its log frequency in every language.  An unseen
word falls back to its character 5-grams (with marks at its ends), or 4-grams if no
5-gram of it was seen, and so on down to single characters.  A text's score is the
posterior of the best language over the sum of all its words.

The model is fitted on about ``sample_rows`` labelled rows at most (chosen by a hash of the
id), each whole, and holds every word and n-gram of them.  All texts are scored whole.

Null texts and texts without a letter give ``und`` with score 0.  Repeated rows are counted and
scored each for itself; columns other than id, text and language are not read.  Words that share
nothing with the model say nothing; a text of such words gets the first language in
alphabetical order with an even score.  With no labelled row every text is ``und``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, held, saved, slices, table, unheld

ORDERS = (5, 4, 3, 2, 1)
SMOOTH = 0.1

#: Words are runs of bytes that are no ASCII sign, digit or control.
_WORDS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ASCII_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))


def words(text: bytes) -> list[bytes]:
    return text.decode(errors="replace").lower().encode(errors="replace").translate(_WORDS).split()


def grams(word: str, n: int) -> list[str]:
    w = word if n == 1 else f"_{word}_"
    return [w[k : k + n] for k in range(len(w) - n + 1)]


def has_letter(text: bytes) -> bool:
    return len(text) != len(text.translate(None, _ASCII_LETTERS)) or any(c.isalpha() for c in text.decode(errors="replace"))


def fit(docs: DataFrame, sample_rows: int = 20_000, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Counts by language of the words (order 0) and n-grams of the sampled rows."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    total = rows.select("lang").count()
    if total > sample_rows:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * sample_rows / total))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unheld()
        seen: Counter = Counter()
        for batch, texts in slices(batches):
            for t, lang in zip(texts, batch.column(batch.schema.get_field_index("lang")).to_pylist()):
                for w, c in Counter(words(t)).items():
                    seen[lang, w] += c
            if len(seen) > 100_000:
                yield told(seen)
                seen = Counter()
        yield told(seen)

    def told(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1].decode() for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "gram", "c"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unheld()
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                out: Counter = Counter()
                for r in batch.slice(at, 2_000).to_pylist():
                    for n in ORDERS:
                        for g in grams(r["gram"], n):
                            out[r["lang"], n, g] += r["c"]
                keys = list(out)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array(list(out.values()), pa.int64())], ["lang", "n", "gram", "c"])

    by_word = saved(rows.mapInArrow(count, "lang string, gram string, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c")))
    by_gram = by_word.mapInArrow(split, "lang string, n int, gram string, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    counts = saved(by_word.select("lang", F.lit(0).alias("n"), "gram", "c").unionByName(by_gram))
    totals = {(r["lang"], r["n"]): (r["c"], r["v"]) for r in counts.groupBy("lang", "n").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}
    # a row for each word or n-gram of the sample, with its counts in the order of the languages
    langs = sorted({lang for lang, _ in totals})
    if not langs:
        return {"langs": [], "tables": {}}
    wide = counts.groupBy("n", "gram").agg(*(F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("c"))), F.lit(0)).alias(f"c{k}") for k, lang in enumerate(langs)))
    return model(wide.toArrow(), langs, totals)


def model(rows: pa.Table, langs: list[str], totals: dict) -> dict:
    """Log frequencies: langs, and for each order the words or n-grams (joined by line feeds, which none holds) with their vectors."""
    n_of = rows.column("n").to_numpy() if rows.num_rows else np.zeros(0, np.int64)
    tables = {}
    for n in (0, *ORDERS):
        own = np.flatnonzero(n_of == n)
        part = rows.take(pa.array(own))
        counts = np.stack([part.column(f"c{k}").to_numpy() for k in range(len(langs))], 1) if len(own) else np.zeros((0, len(langs)))
        size = np.array([(lambda c, v: c + SMOOTH * (v + 1))(*totals.get((lang, n), (0, 0))) for lang in langs])
        tables[n] = ("\n".join(part.column("gram").to_pylist()), np.log((counts + SMOOTH) / size).astype(np.float32))
    return {"langs": langs, "tables": tables}


class Scorer(dict):
    """Rows of a growing matrix by word."""

    def __init__(self, fitted: dict):
        super().__init__()
        self.langs = fitted["langs"]
        self.tables = {n: ({g: k for k, g in enumerate(grams_.split("\n"))} if len(values) else {}, values) for n, (grams_, values) in fitted["tables"].items()}
        self.matrix = np.zeros((1 << 16, max(1, len(self.langs))))

    def vector(self, word: str) -> np.ndarray:
        row, values = self.tables[0]
        if (k := row.get(word)) is not None:
            return values[k]
        for n in ORDERS:
            row, values = self.tables[n]
            known = [k for g in grams(word, n) if (k := row.get(g)) is not None]
            if known:
                return values[known].sum(0) / len(known)
        return np.zeros(len(self.langs))

    def __missing__(self, word: bytes) -> int:
        k = len(self)
        if k >= len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
        self.matrix[k] = self.vector(word.decode())
        self[word] = k
        return k

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        if len(self) > 150_000:
            self.clear()
        langs, scores = [], []
        for t in texts:
            if not t or not self.langs or not has_letter(t):
                langs.append("und")
                scores.append(0.0)
                continue
            w = words(t)
            total = np.zeros(len(self.langs))
            for at in range(0, len(w), 1 << 16):
                ids = [self[x] for x in w[at : at + (1 << 16)]]
                total += self.matrix[ids].sum(0)
            best = int(total.argmax())
            langs.append(self.langs[best])
            scores.append(1.0 / math.fsum(np.exp(total - total[best])))
        return langs, scores


def predict(docs: DataFrame, fitted: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the columns of ``docs`` but the text, lang_pred, score."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(fitted)
    key = shipped._jbroadcast.id()
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(("langid", key), lambda: Scorer(shipped.value))
        for batch, texts in slices(batches):
            langs, scores = scorer.predict(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def kept(docs: DataFrame, fitted: dict, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of at least ``least``."""
    shipped = docs.sparkSession.sparkContext.broadcast(fitted)
    key = shipped._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(("langid", key), lambda: Scorer(shipped.value))
        for batch, texts in slices(batches, text_col):
            langs, scores = scorer.predict(texts)
            yield batch.filter(pa.array([lang != "und" and s >= least for lang, s in zip(langs, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    rows = predict(docs, fit(docs.filter(~held_out)))
    return rows.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
