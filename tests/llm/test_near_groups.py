"""Groups of near copies: no lost link, no text without a similar one, over blocks too, and the stage on odd rows."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from assayer.llm import simhash, stages

LOWER = simhash._LOWER


def groups(texts, similarity=0.8):
    """The first text of each text's group, over the pairs of all texts that share a shingle."""
    sets = []
    for t in texts:
        w = (t or "").encode().translate(LOWER).split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    same = defaultdict(list)
    for i, x in enumerate(sets):
        same[x].append(i)
    parent = list(range(len(texts)))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    def join(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    holds, unique = defaultdict(list), list(same)
    for i, x in enumerate(unique):
        for a in same[x]:
            join(a, same[x][0])
        shared = Counter(j for g in x for j in holds[g])
        for j, n in shared.items():
            if n >= similarity * (len(x) + len(unique[j]) - n):
                join(same[x][0], same[unique[j]][0])
        for g in x:
            holds[g].append(i)
    return [find(a) for a in range(len(texts))]


def kept(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.least: r.component_id for r in simhash.near_groups(df).collect()}


def test_pairs_among_texts_of_the_same_words(spark):
    """Texts of the same words in other orders share all fingerprints of words; each 20 have one pair of near copies."""
    r, texts = random.Random(1), []
    for g in range(20):
        w = [f"w{g}x{k}" for k in range(200)]
        for _ in range(10):
            x = w[:]
            r.shuffle(x)
            texts.append(" ".join(x))
        y = texts[-1].split()
        y[100] = "other"
        texts.append(" ".join(y))
    got = kept(spark, texts)
    assert {a: b for a, b in got.items() if a != b} == {11 * g + 10: 11 * g + 9 for g in range(20)}


def test_recall_and_precision(spark):
    """At least 95 % of what should go goes, and at least 98 % of what goes has a similar text in its group."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()
    texts = [d.text for d in docs]
    r = random.Random(8)
    for k in range(300):  # edited copies around the bound
        w = r.choice(texts[:600]).split()
        for _ in range(r.randrange(0, max(1, len(w) // 25))):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        texts.append(" ".join(w))
    expected = {k for k, first in enumerate(groups(texts)) if first != k}
    got = kept(spark, texts)
    gone = {k for k in range(len(texts)) if got.get(k) != k}
    assert len(gone & expected) >= 0.95 * len(expected) and len(gone & expected) >= 0.98 * len(gone)
    assert len(gone - expected) == 0


def test_blocks_lose_no_link(spark, monkeypatch):
    r, texts = random.Random(5), []
    base = [f"t{k}" for k in range(300)]
    for k in range(60):  # each is near the one before, the last far from the first
        base = base[:]
        base[(5 * k) % 300] = f"u{k}"
        texts.append(" ".join(base))
    texts += [" ".join(f"z{r.randrange(50)}" for _ in range(300)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    members = df.select(F.lit(0).cast("long").alias("root"), F.col("doc_id").alias("node"), F.col("doc_id").alias("least"), F.xxhash64("text").alias("text_key"))
    for most in (1 << 22, 3000):
        edges = {(e.a, e.b) for e in simhash.verified(df, members, 5, 0.8, most).collect()}
        parent = list(range(len(texts)))
        for _ in texts:
            for a, b in edges:
                parent[a] = parent[b] = min(parent[a], parent[b])
        assert parent == groups(texts)


def test_third_level_of_a_dense_bucket(spark):
    """More members than a group may have at both levels: blocks meet pair by pair."""
    fps = [(k << 4) & 0xFFFF for k in range(40)] + [1, 3]
    df = spark.createDataFrame([(f,) for f in fps], "fp long").distinct()

    def parts(edges):
        near = defaultdict(set)
        for e in edges.collect():
            near[e.a].add(e.b)
            near[e.b].add(e.a)
        seen, out = set(), []
        for f in fps:
            if f not in seen:
                todo, part = [f], set()
                while todo:
                    x = todo.pop()
                    if x not in part:
                        part.add(x)
                        todo += near[x]
                seen |= part
                out.append(sorted(part))
        return sorted(out)

    assert parts(simhash.links(df, most_group=2)) == parts(simhash.links(df)) == parts(simhash.links(df, most_group=7))


@pytest.mark.parametrize("n", [0, 1])
def test_stage_on_odd_rows(spark, n):
    schema = "doc_id long, text string, lang string, root string, node string, least string"
    long = " ".join(f"w{k % 5000}" for k in range(60_000))
    rows = [(1, None, "a", "x", "y", "z"), (2, "", "a", "x", "y", "z"), (3, long, "a", "x", "y", "z"), (4, long + " more", "a", "x", "y", "z"), (None, long, "a", "x", "y", "z"), (5, "one two three", "a", "x", "y", "z"), (5, "one two three", "a", "x", "y", "z"), (6, "One Two\tthree", "a", "x", "y", "z"), (None, None, "a", "x", "y", "z")]
    docs = spark.createDataFrame(rows * n, schema)
    out = stages.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(["1", "3", "5", "5", "None", "None"] * n)
