"""SimHash near-duplicates with fuzzy hashing by the binary Golay code.

A fingerprint has 64 bits; a bit is set if over half of the XXH64 hashes (seed 42) of
the text's 3-word shingles, repeats included, have it.  Two fingerprints are linked
if they differ in at most three bits.

Candidates.  The fingerprint is cut into four segments of 16 bits.  If two differ in at
most three bits, some segment i is equal in both and the next one (i + 1 modulo 4) differs
in at most one bit: else every equal segment would be followed by two errors or more, and
every other one holds an error.  A segment, padded to 23 bits, is decoded with the
perfect (23, 12) Golay code: every 23-bit word lies within distance 3 of just one codeword.
Its keys are the index of that codeword and, if the distance is 3, the indexes of the five
codewords at distance 4: words that differ in one bit always share a key.  (If x decodes
to c and y does not, y is at distance 4 from c, and so at distance 3 from its own
codeword, and c is among its keys.)  A key of a fingerprint is segment i, its
number, and one of the codeword indexes of the next segment.

Join and verify.  Distinct fingerprints meet by key; in each group a search from
neighbour to neighbour compares only with those not yet reached, so that a dense
group costs about as much as it has members, and gives one edge for each member
instead of all pairs.  A group of more than ``most_group`` members is never held: its members are
dealt anew by a codeword index of one of the two other segments as well.  At most
one of these holds two of the three errors, so linked members still meet.  What is too large even so is cut into
blocks, and every two blocks meet in a task of their own.  The edges
of all groups join to components by alternating large-star and small-star steps over
Spark joins, with a written table after each.  No link between different fingerprints is
lost.

``near_groups`` finds texts whose sets of 5-word shingles have a similarity of 0.8 or more.  A few
changed words change a share of the shingles five times as large, so candidates come from
``spaces`` independent fingerprints of the set of words, linked as above; a search goes on only over members whose
second signatures, 128-bit SimHashes of the set of shingles, are near too (three deviations beyond the similarity, so that hardly a
link is missed).  Within the components of these loose links the sets of shingles themselves are compared: a
search over a component finds its groups exactly.  So no text joins a group without a text in it that is similar.

Null, empty and blank texts have fingerprint zero, linked like any other.  Null ids
are left out of the smallest id of a component; a component without any id has a
null component.  Repeated rows stay repeated.  Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, slices, table, two_columns, unheld

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes | None, words: int = 3) -> int:
    w = text.translate(_LOWER).split() if text else []
    if not w:
        return 0
    h = xxhash.xxh64_intdigest
    if len(w) <= words:
        return h(b" ".join(w), 42)
    if words == 3:
        hashes = [h(b"%b %b %b" % s, 42) for s in zip(w, w[1:], w[2:])]
    else:
        hashes = [h(b" ".join(w[k : k + words]), 42) for k in range(len(w) - words + 1)]
    a = np.array(hashes, np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(a), 1 << 14):
        ones += np.unpackbits(a[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * ones > len(a)).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row per document: doc_id, fp (the fingerprint's 64 bits as a signed long)."""
    df = two_columns(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            fps = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, fp long")


@cache
def golay_keys() -> np.ndarray:
    """For every 16-bit word, padded to 23 bits: its keys, -1 where it has fewer than six.

    Codewords are the multiples of x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of degree
    under 23; a codeword's index is its factor.
    """
    generator = 0b101011100011
    codewords = np.zeros(1 << 12, np.int32)
    for k in range(12):
        codewords ^= np.where(np.arange(1 << 12) >> k & 1, generator << k, 0).astype(np.int32)
    keys = np.full((1 << 16, 6), -1, np.int16)
    for word in range(0, 1 << 16, 512):
        d = np.bitwise_count(np.arange(word, word + 512, dtype=np.int32)[:, None] ^ codewords[None])
        row, codeword = np.nonzero(d <= 4)
        far = d[row, codeword]
        nearest = np.full(512, 4, np.uint8)
        np.minimum.at(nearest, row, far)
        kept = (far == nearest[row]) | (nearest[row] == 3)
        row, codeword = row[kept], codeword[kept]
        keys[word + row, np.arange(len(row)) - np.searchsorted(row, row)] = codeword
    return keys


PAIRS = [(i, (i + 1) % 4) for i in range(4)]


def segments(fps: np.ndarray) -> list[np.ndarray]:
    u = fps.view(np.uint64)
    return [(u >> np.uint64(16 * k)).astype(np.int64) & 0xFFFF for k in range(4)]


def keyed(fps: np.ndarray, space: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints, and the position of the fingerprint of each; ``space`` keeps kinds of fingerprints apart."""
    table_of, parts = golay_keys(), segments(fps)
    space = np.broadcast_to(np.asarray(space, np.int64), len(fps))
    keys, of = [], []
    for i, j in PAIRS:
        near = table_of[parts[j]].astype(np.int64)
        row, column = np.nonzero(near >= 0)
        keys.append(((space[row] * 4 + i) << 28) | (parts[i][row] << 12) | near[row, column])
        of.append(row)
    return np.concatenate(keys), np.concatenate(of)


def rekeyed(key: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Finer keys for members of large groups: the key with a codeword index of one of the two segments it does not use.

    Equal finer keys of different keys cost a comparison, no more.
    """
    table_of, parts = golay_keys(), np.stack(segments(fps))
    first = (key >> 28) & 3
    keys, of = [], []
    for step in (2, 3):
        other = (first + step) % 4
        near = table_of[parts[other, np.arange(len(fps))]].astype(np.int64)
        row, column = np.nonzero(near >= 0)
        mixed = key[row].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + ((near[row, column] << 2) | step).astype(np.uint64)
        mixed ^= mixed >> np.uint64(32)
        keys.append((mixed * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64))
        of.append(row)
    return np.concatenate(keys), np.concatenate(of)


def differing(a: np.ndarray, b) -> np.ndarray:
    """Number of differing bits; numpy would count those of the absolute value of a signed number."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def edges_of(fps: np.ndarray, most: int, more: np.ndarray | None = None, more_bits: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For a group of fingerprints: positions of each member that a search reaches, and of the member it is reached from.

    ``more`` (columns by members) are second signatures, which must not differ in over ``more_bits`` bits either.
    """
    left = np.argsort(fps, kind="stable")
    member, source = [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = differing(fps[left], fps[at]) <= most
            if more is not None:
                close = np.flatnonzero(near)
                far = sum(differing(c[left[close]], c[at]).astype(np.int64) for c in more) > more_bits
                near[close[far]] = False
            if near.any():
                new = left[near]
                queue.extend(new.tolist())
                member.append(new)
                source.append(np.full(len(new), at))
                left = left[~near]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *member]), np.concatenate([none, *source])


def _meet(most: int, most_group: int | None, extra: int = 0, more_bits: int = 0):
    """Groups of rows (key, fp, node, second signatures), sorted by key: edges between nodes; members of too large groups come back with their key."""
    names = ["key", "fp", "a", "b", *_second(extra)]

    def told(key, fp, a, b, *more):
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp), pa.array(a), pa.array(b), *map(pa.array, more)], names)

    def large(rows):
        return told(rows[0], rows[1], rows[2], pa.nulls(len(rows[0]), pa.int64()), *rows[3:])

    def linked(key, fp, node, *more):
        starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
        sizes = np.diff(np.append(starts, len(key)))
        two = starts[sizes == 2]
        near = differing(fp[two], fp[two + 1]) <= most
        if extra:
            near &= sum(differing(c[two], c[two + 1]).astype(np.int64) for c in more) <= more_bits
        two = two[near]
        member, source = [node[two]], [node[two + 1]]
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            m, r = edges_of(fp[s : s + n], most, np.stack([c[s : s + n] for c in more]) if extra else None, more_bits)
            member.append(node[s + m])
            source.append(node[s + r])
        m, r = np.concatenate(member), np.concatenate(source)
        each = np.unique(np.stack([np.maximum(m, r), np.minimum(m, r)], 1)[m != r], axis=0)
        none = pa.nulls(len(each), pa.int64())
        return told(none, none, each[:, 0], each[:, 1], *[none] * extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * (3 + extra)
        over = None  # the key whose members go on
        for batch in batches:
            rows = [np.concatenate([r, c.to_numpy()]) for r, c in zip(rest, batch.columns)]
            if not len(rows[0]):
                continue
            if over is not None:
                n = int(np.searchsorted(rows[0], over, "right"))
                if n:
                    yield large([r[:n] for r in rows])
                    rows = [r[n:] for r in rows]
                if not len(rows[0]):
                    rest = rows
                    continue
                over = None
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            if last:
                yield from whole(*(r[:last] for r in rows))
            rest = [r[last:] for r in rows]
            if most_group and len(rest[0]) > most_group:
                over = rest[0][0]
                yield large(rest)
                rest = [r[:0] for r in rest]
        if len(rest[0]):
            yield from whole(*rest)

    def whole(*rows):
        if most_group:
            starts = np.concatenate([[0], np.flatnonzero(np.diff(rows[0])) + 1])
            sizes = np.diff(np.append(starts, len(rows[0])))
            over = np.repeat(sizes > most_group, sizes)
            if over.any():
                yield large([r[over] for r in rows])
                rows = [r[~over] for r in rows]
        if len(rows[0]):
            yield linked(*rows)

    return run


def _second(extra: int) -> list[str]:
    return [f"v{k}" for k in range(extra)]


def _columns(extra: int, *names: str) -> str:
    return ", ".join(f"{c} long" for c in [*names, *_second(extra)])


def links(distinct: DataFrame, most: int = 3, most_group: int = 4096, extra: int = 0, more_bits: int = 0) -> DataFrame:
    """Edges (a, b), a > b, that join the nodes of distinct fingerprints as all links of a space do.

    ``distinct`` has fp, and may have space (a small number; fingerprints of different spaces
    are never linked), node (the fingerprint itself if it is missing) and ``extra`` second signatures v0, v1, ..., in
    which linked nodes may differ in ``more_bits`` bits.
    """
    if not 0 <= most <= 3:
        raise ValueError("segments and code allow at most three differing bits")
    space = F.col("space").cast("long") if "space" in distinct.columns else F.lit(0).cast("long")
    node = F.col("node") if "node" in distinct.columns else F.col("fp")
    more = _second(extra)
    rows = distinct.select(space.alias("space"), F.col("fp").alias("fp"), node.alias("node"), *more)
    names = ["key", "fp", "node", *more]

    def dealt(keys_of):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    first, *rest = (c.to_numpy() for c in batch.slice(at, 4096).columns)
                    key, of = keys_of(first, rest[0])
                    yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(c[of]) for c in rest)], names)

        return run

    def met(keys: DataFrame, size: int | None) -> DataFrame:
        dealt_keys = keys.repartition(n, "key").sortWithinPartitions("key")
        return saved(dealt_keys.mapInArrow(_meet(most, size, extra, more_bits), _columns(extra, "key", "fp", "a", "b")).distinct())

    again = lambda df: df.filter("key IS NOT NULL").select("key", "fp", F.col("a").alias("node"), *more)
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = _columns(extra, "key", "fp", "node")
    first = met(rows.mapInArrow(dealt(lambda s, f: keyed(f, s)), keys), most_group)
    edges = first.filter("key IS NULL").select("a", "b")
    if not (large := again(first)).isEmpty():
        second = met(large.mapInArrow(dealt(lambda k, f: rekeyed(k, f)), keys), most_group)
        edges = edges.unionByName(second.filter("key IS NULL").select("a", "b"))
        if not (large := again(second)).isEmpty():
            third = met(_blocks(large, "key", F.lit(1), most_group // 2), None)
            edges = edges.unionByName(third.select("a", "b"))
    return edges.distinct()


def _blocks(rows: DataFrame, key: str, weight, most: int) -> DataFrame:
    """The rows with a new key: groups of a greater weight than ``most`` are cut into blocks, and each two blocks are a group.

    Within a group, rows are dealt to blocks by a hash of their node.
    """
    sizes = rows.groupBy(F.col(key).alias("_group")).agg(F.ceil(F.sum(weight) / most).cast("int").alias("_n"))
    own = F.pmod(F.xxhash64("node"), F.col("_n")).cast("int")
    both = rows.join(sizes, rows[key] == F.col("_group")).withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    pair = F.when(F.col("_n") == 1, F.col("_group")).otherwise(F.xxhash64("_group", F.least("_own", "_other"), F.greatest("_own", "_other")))
    return both.select(*(pair.alias(key) if c == key else F.col(c) for c in rows.columns))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of every node with an edge.

    Every node of an edge (a, b), a > b, points to a smaller one; each round sends all
    nodes that share a node to the smallest around it, until stars are left.
    """
    edges = saved(edges)
    while True:
        # large star: of what surrounds a node, the larger ones go to the smallest around it
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # a node without larger ones around it keeps what it points to, through those nodes' own rows
        large = saved(large.distinct())
        # small star: of what a node points to, all go to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after = saved(small.filter("a <> b").distinct())
        same = after.count() == edges.count() and after.exceptAll(edges).isEmpty()
        edges = after
        if same:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def clustered(prints: DataFrame, most: int = 3) -> DataFrame:
    """The rows of ``fingerprints`` with component_id, the smallest doc_id that links reach."""
    prints = saved(prints)
    least = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    stars = saved(components(links(least.select("fp"), most)))
    named = least.join(stars, least["fp"] == stars["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = stars.select("node", "root").unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
    # only fingerprints with links need another table; the others' component is their own least id
    linked = moved.join(ids, "root").select(F.col("node").alias("fp"), "component_id")
    each = least.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(each, "fp")


_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)


def shingles_of(h: np.ndarray, words: int) -> np.ndarray:
    """The set of hashes of ``words`` consecutive word hashes, of all if there are fewer."""
    k = min(words, len(h))
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + n]) * _MIX
        out ^= out >> np.uint64(32)
    return np.unique(out)


class Signer:
    """Signatures of texts: SimHashes of the set of words and of the set of shingles; words are hashed once and remembered."""

    def __init__(self, words: int, spaces: int, more: int):
        self.words, self.spaces, self.more = words, spaces, more
        self.known: dict[bytes, int] = {}

    def sums(self, h: np.ndarray, n: int) -> np.ndarray:
        """``n`` fingerprints of a set of hashes."""
        ones = np.zeros((n, 64), np.int64)
        for at in range(0, len(h), 1 << 13):
            y = h[None, at : at + (1 << 13)] * _ODD[:n, None]
            y ^= y >> np.uint64(31)
            y *= _MIX
            y ^= y >> np.uint64(29)
            ones += np.unpackbits(y.astype("<u8").view(np.uint8).reshape(n, -1, 8), axis=2, bitorder="little").sum(1, dtype=np.int64)
        return np.packbits(2 * ones > len(h), axis=1, bitorder="little").view("<i8").reshape(n)

    def sign(self, text: bytes | None) -> np.ndarray:
        w = text.translate(_LOWER).split() if text else []
        if not w:
            return np.zeros(self.spaces + self.more, np.int64)
        if len(self.known) > 300_000:
            self.known.clear()
        known = self.known
        for x in set(w):
            if x not in known:
                known[x] = xxhash.xxh64_intdigest(x, 42)
        h = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
        return np.concatenate([self.sums(np.unique(h), self.spaces), self.sums(shingles_of(h, self.words), self.more)])


def most_bits(similarity: float, bits: int, slack: float = 3.0) -> int:
    """Differing bits that sets of this Jaccard similarity have at most, but for ``slack`` standard deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * p + slack * math.sqrt(bits * p * (1 - p)))


def similar_sets(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """For sets of numbers: positions of each set that a search over similar ones reaches, and of the set it is reached from."""
    sizes = np.array([len(x) for x in sets])
    _, values = np.unique(np.concatenate(sets), return_inverse=True)
    left, flag = np.argsort(sizes, kind="stable"), np.zeros(int(values.max(initial=-1)) + 1, np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    member, source = [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            some = left[(sizes[left] * similarity <= sizes[at]) & (sizes[at] * similarity <= sizes[left])]
            if not len(some):
                continue
            own = values[starts[at] : starts[at + 1]]
            flag[own] = 1
            places = np.repeat(starts[some] - np.concatenate([[0], np.cumsum(sizes[some])[:-1]]), sizes[some]) + np.arange(sizes[some].sum())
            common = np.add.reduceat(flag[values[places]], np.concatenate([[0], np.cumsum(sizes[some])[:-1]]))
            flag[own] = 0
            new = some[common >= similarity * (sizes[at] + sizes[some] - common)]
            if len(new):
                queue.extend(new.tolist())
                member.append(new)
                source.append(np.full(len(new), at))
                left = left[~np.isin(left, new)]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *member]), np.concatenate([none, *source])


def _exact(similarity: float):
    """Groups of rows (root, node, shingles), sorted by root: edges between nodes whose sets are similar."""

    def edges(nodes, sets):
        m, r = similar_sets([np.frombuffer(x, np.uint64) for x in sets], similarity)
        node = np.array(nodes, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(node[m], node[r])), pa.array(np.minimum(node[m], node[r]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, nodes, sets = None, [], []
        for batch in batches:
            for k, node, x in zip(*(c.to_pylist() for c in batch.columns)):
                if k != root:
                    if len(nodes) > 1:
                        yield edges(nodes, sets)
                    root, nodes, sets = k, [], []
                nodes.append(node)
                sets.append(x)
        if len(nodes) > 1:
            yield edges(nodes, sets)

    return run


def verified(docs: DataFrame, members: DataFrame, words: int, similarity: float, most_shingles: int = 1 << 22) -> DataFrame:
    """Edges (a, b), a > b, between nodes of one root whose texts' sets of shingles are similar, enough to join what all such pairs join.

    ``docs`` has doc_id and text, ``members`` root, node and one text of it by ``least`` and ``text_key``.  Roots with over
    ``most_shingles`` shingles in all are compared in blocks, every two blocks in a task.
    """
    keyed_docs = docs.select(F.col("doc_id").alias("_id"), "text", F.xxhash64("text").alias("_key"))
    texts = keyed_docs.join(members, (F.col("_key") == F.col("text_key")) & F.col("_id").eqNullSafe(F.col("least"))).select("root", "node", "text").dropDuplicates(["node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, some in slices(batches):
            sets = []
            for t in some:
                w = t.translate(_LOWER).split() if t else []
                known = {x: xxhash.xxh64_intdigest(x, 42) for x in set(w)}
                sets.append(shingles_of(np.fromiter(map(known.__getitem__, w), np.uint64, len(w)), words) if w else np.zeros(0, np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64())], ["root", "node", "shingles", "n"])

    sets = saved(texts.mapInArrow(run, "root long, node long, shingles binary, n long"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _blocks(sets, "root", F.col("n"), most_shingles).select("root", "node", "shingles").repartition(n, "root").sortWithinPartitions("root")
    return dealt.mapInArrow(_exact(similarity), "a long, b long").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, spaces: int = 6, more: int = 2) -> DataFrame:
    """(least, component_id), one row for each signature that occurs: the smallest id that has it, and that of its group."""
    df = two_columns(docs, id_col, text_col)
    kind = df.schema["doc_id"].dataType.simpleString()
    fps, rest = [f"w{k}" for k in range(spaces)], _second(more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unheld()
        signer = Signer(words, spaces, more)
        for batch, texts in slices(batches):
            each = np.array([signer.sign(t) for t in texts], np.int64).reshape(-1, spaces + more)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(np.ascontiguousarray(c)) for c in each.T)], ["doc_id", "text_key", *fps, *rest])

    signed = df.withColumn("text_key", F.xxhash64("text")).mapInArrow(run, f"doc_id {kind}, text_key long, " + ", ".join(f"{c} long" for c in [*fps, *rest]))
    # of the texts with one signature, that of the smallest id is compared
    one = F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_key"))), F.min(F.struct("doc_id", "text_key")))
    nodes = saved(signed.groupBy(*fps, *rest).agg(one.alias("_one")).select(*fps, *rest, F.col("_one.doc_id").alias("least"), F.col("_one.text_key").alias("text_key"), F.monotonically_increasing_id().alias("node")))
    spread = F.explode(F.array(*(F.struct(F.lit(k).alias("space"), F.col(c).alias("fp")) for k, c in enumerate(fps)))).alias("s")
    spaced = nodes.select("node", spread, *rest).select("s.space", "s.fp", "node", *rest)
    loose = saved(components(links(spaced, extra=more, more_bits=most_bits(similarity, 64 * more))))
    members = loose.select("node", "root").unionByName(loose.select(F.col("root").alias("node"), "root").distinct())
    members = members.join(nodes.select("node", "least", "text_key"), "node")
    stars = saved(components(verified(df, members, words, similarity)))
    named = nodes.select("node", "least").join(stars, "node", "left").select("least", F.coalesce("root", "node").alias("root"))
    return named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("least", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    rows = clustered(fingerprints(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
