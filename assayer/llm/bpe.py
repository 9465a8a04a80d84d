"""Byte-level BPE encoding and decoding with forced-boundary splitting.

A pair of bytes that occurs inside no vocabulary token can never be bridged by a
merge: between two such bytes there is a certain cut.  The table of pairs is read
from the vocabulary.  It serves at two levels:

* a text is cut before every space whose left neighbour is no white space: always a
  border of the pre-tokenising pattern, over which no token reaches; the resulting
  chunks repeat and are encoded once;
* each pre-token is cut at every pair that the table rules out, so that the merges
  run over short fragments, however long the pre-token is.

Fragments are encoded independently and their ids concatenated.  Null texts count
as empty; empty texts have no ids.  Rows are handled one by one, so repeated rows,
ties and extra columns change nothing.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, slices, two_columns

#: The pattern that splits text before the merges.
PRETOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Chunks, and pre-tokens, that a worker remembers.
REMEMBERED = 250_000

LITTLE = sys.byteorder == "little" and array("I").itemsize == 4


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable bytes stand
    for themselves, the others in order for the code points from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Remembered(dict):
    """Ids of strings as packed little-endian integers, computed when first asked for.

    The first ``REMEMBERED`` short strings are kept: frequent ones come early.
    """

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key: str) -> bytes:
        ids = self.compute(key)
        if len(self) < REMEMBERED and len(key) <= 64:
            self[key] = ids
        return ids


class ByteBPE:
    """Encoder and decoder for one vocabulary file of the tokenizers library."""

    def __init__(self, file: bytes):
        spec = json.loads(file)
        letter = byte_letters()
        raw = lambda token: bytes(letter[c] for c in token)
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.single = [vocab.get(bytes([b])) for b in range(256)]
        self.rank: dict[int, int] = {}  # by left << 32 | right
        self.made: list[int] = []  # by rank
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = map(raw, pair.split(" ") if isinstance(pair, str) else pair)
            self.rank[vocab[left] << 32 | vocab[right]] = rank
            self.made.append(vocab[left + right])
        inside = np.zeros((256, 256), bool)
        for token in vocab:
            for a, b in zip(token, token[1:]):
                inside[a, b] = True
        self.inside = [row.tobytes() for row in inside]
        self.bytes_of = token_bytes(file)
        self.pattern = regex.compile(PRETOKENS)
        self.unsafe = re.compile(r"\s (?:\s|$)")
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bare = Remembered(self.pretokenised)
        self.spaced = Remembered(lambda chunk: self.pretokenised(" " + chunk))
        self.token = Remembered(self.cut)

    def merged(self, fragment: bytes) -> list[int]:
        """Ids of one fragment: the lowest rank is merged first, from the left."""
        ids = [self.single[b] for b in fragment]
        if len(ids) > 64:
            return self.merged_long(ids)
        get, none = self.rank.get, 1 << 60
        ranks = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) < none:
            k = ranks.index(low)
            ids[k : k + 2] = [self.made[low]]
            del ranks[k]
            if k:
                ranks[k - 1] = get(ids[k - 1] << 32 | ids[k], none)
            if k < len(ranks):
                ranks[k] = get(ids[k] << 32 | ids[k + 1], none)
        return ids

    def merged_long(self, ids: list[int]) -> list[int]:
        """The same through a heap: n log n steps for n bytes without a cut."""
        n, get = len(ids), self.rank.get
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (rank := get(ids[a] << 32 | ids[b])) is not None:
                heapq.heappush(heap, (rank, a, ids[a], ids[b]))

        for k in range(n - 1):
            offer(k, k + 1)
        while heap:
            rank, a, x, y = heapq.heappop(heap)
            b = right[a]
            if ids[a] != x or b < 0 or ids[b] != y:
                continue
            ids[a], ids[b] = self.made[rank], -1
            right[a] = right[b]
            if right[a] >= 0:
                left[right[a]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [i for i in ids if i >= 0]

    def cut(self, token: str) -> bytes:
        """Ids of a pre-token: its fragments between certain cuts, encoded one by one."""
        b, inside, out, start = token.encode(), self.inside, [], 0
        for k, pair in enumerate(zip(b, b[1:]), 1):
            if not inside[pair[0]][pair[1]]:
                out += self.merged(b[start:k])
                start = k
        out += self.merged(b[start:] if start else b)
        return array("I", out).tobytes() if LITTLE else np.array(out, "<u4").tobytes()

    def pretokenised(self, text: str) -> bytes:
        """Ids of a text whose ends are borders of pre-tokens."""
        return b"".join(map(self.token.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.splitter and any(s in text for s in self.special):
            return b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else self.encode(p) for p in self.splitter.split(text) if p)
        if self.unsafe.search(text):
            return self.pretokenised(text)
        first, *rest = text.split(" ")
        return self.bare[first] + b"".join(map(self.spaced.__getitem__, rest))

    def forget(self) -> None:
        for memory in (self.bare, self.spaced, self.token):
            memory.clear()

    def decode(self, ids: bytes) -> str:
        return decoded(self.bytes_of, ids)


def decoded(bytes_of: list[bytes], ids: bytes) -> str:
    return b"".join(map(bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode(errors="replace")


def token_bytes(file: bytes) -> list[bytes]:
    """The bytes of every id: all that decoding needs."""
    spec = json.loads(file)
    letter = byte_letters()
    tokens = {i: bytes(letter[c] for c in t) for t, i in spec["model"]["vocab"].items()} | {a["id"]: a["content"].encode() for a in spec["added_tokens"]}
    out = [b""] * (max(tokens) + 1)
    for i, t in tokens.items():
        out[i] = t
    return out


def _coder(shipped) -> ByteBPE:
    """One coder for each worker process and vocabulary."""
    return held(("bpe", shipped.id), lambda: ByteBPE(shipped.value))


class _Shipped:
    """The vocabulary file as a broadcast: its size does not depend on the data."""

    def __init__(self, spark, path: str):
        with open(path, "rb") as f:
            self.broadcast = spark.sparkContext.broadcast(f.read())
        self.id = self.broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self) -> bytes:
        return self.broadcast.value


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit integers)."""
    df = two_columns(docs, id_col, text_col)
    shipped = _Shipped(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shipped)
        try:
            for batch, texts in slices(batches):
                ids = [coder.encode(t.decode()) if t else b"" for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])
        finally:
            coder.forget()  # an idle worker keeps no memory of a task

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """The rows of ``encode`` with the column decoded; broken UTF-8 gives U+FFFD as usual."""
    shipped = _Shipped(encoded.sparkSession, vocabulary)
    df = encoded.select("doc_id", "n_tokens", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = held(("bytes", shipped.id), lambda: token_bytes(shipped.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = [decoded(bytes_of, i) if i else "" for i in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary, decoded string")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``decode(encode(docs))`` in one pass, so that a task has one Python worker, not two."""
    df = two_columns(docs, id_col, text_col)
    shipped = _Shipped(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shipped)
        try:
            for batch, texts in slices(batches):
                ids = [coder.encode(t.decode()) if t else b"" for t in texts]
                back = [coder.decode(i) if i else "" for i in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])
        finally:
            coder.forget()

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary, decoded string")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    both = round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary())
    return both.select("doc_id", "n_tokens", F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
