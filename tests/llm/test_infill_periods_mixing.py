"""Infill, periodic runs and mixing against brute force, on odd rows: nulls, empty and long texts, ties, repeats, no rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from assayer.llm import infill, mixing, periods

SCHEMA = "doc_id long, text string, source string, form string, output string, size long, bucket long, hash long, runs string, best string"
LONG = " ".join(f"wörd{k % 977}" for k in range(40_000))
TEXTS = [None, "", " \n\t ", "one", "<P> a sentinel", "x<S", "a < b > c 漢字 é" * 30, "😀" * 7, LONG, "one", "de la " * 20, "de la " * 20, "x" * 150_000]


def frame(spark, texts, sources=None, ids=None):
    rows = [(ids[k] if ids else k, t, sources[k] if sources else "s", "a", "b", 1, 2, 3, "r", "q") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# infill


def sliced_form(doc_id, text):
    text, h = text or "", sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return "plain", None, None, text
    p, m, s = text[:i], text[i:j], text[j:]
    return ("spm", i, j - i, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", i, j - i, f"<P>{p}<S>{s}<M>{m}")


def test_infill_equals_slicing(spark):
    texts = TEXTS * 6
    ids = [None, *range(1, len(texts))]
    out = infill.restored(infill.rotated(frame(spark, texts, ids=ids))).collect()
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    by_id = {r.doc_id: r for r in out}
    assert len(out) == len(texts)
    for i, t in zip(ids, texts):
        r = by_id[i]
        assert (r.form, r.prefix_chars, r.middle_chars, r.output) == sliced_form(i, t)
        assert r.n == len(t or "") and r.restored == (t or "")
    assert infill.restored(infill.rotated(frame(spark, []))).count() == 0


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_every_cut_comes_back(form):
    text = "a<é漢>😀<S"
    for i in range(len(text) + 1):
        for m in range(len(text) + 1 - i):
            out = infill.transformed(text.encode(), form, i, m)
            p, x, s = text[:i], text[i : i + m], text[i + m :]
            assert out.decode() == (f"<P>{p}<S>{s}<M>{x}" if form == "psm" else f"<S>{s}<P>{p}<M>{x}")
            assert infill.restored_text(out, form).decode() == text


def test_repeated_rows_and_shares(spark):
    out = infill.rotated(frame(spark, ["some text here"] * 3000, ids=[k // 2 for k in range(3000)])).collect()
    by_id = defaultdict(set)
    for r in out:
        by_id[r.doc_id].add(r.output)
    assert all(len(v) == 1 for v in by_id.values())
    n = Counter(r.form for r in out)
    assert 0.08 < n["plain"] / 3000 < 0.12 and 0.17 < n["spm"] / (n["spm"] + n["psm"]) < 0.23


def test_infill_query_equals_sql(spark, sf_dir):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert sorted(map(tuple, infill.query(spark, sf_dir).collect())) == sorted(c.sql(infill.SQL).fetchall())


# periodic runs


def all_runs(w, least=12):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            part = w[i : i + length]
            if length >= max(least, 2 * q) and not any(part[k:] == part[:-k] for k in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out)


def dropped(w, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return [x for k, x in enumerate(w) if k not in gone]


def test_sums_of_squares_are_exact():
    r = np.random.default_rng(1)
    for block, distances, top in ((1, 1, 5), (2, 6, 30_000), (8, 16, 15_000), (16, 40, 11_000)):
        x, y = (r.integers(0, top, (n, 9)).astype(np.uint64) for n in (block, distances + block - 1))
        expected = [((x.astype(int) - y[d : d + block].astype(int)) ** 2).sum(0) for d in range(distances)]
        assert (periods.mismatches(x, y, distances) == np.array(expected)).all()


def test_runs_equal_brute_force():
    r = random.Random(7)
    for _ in range(250):
        texts = []
        for _ in range(r.randrange(1, 6)):
            n, k = r.choice([0, 1, 11, 12, 13, 40, 110]), r.choice([1, 2, 3, 9, 40])
            w = [b"%d" % r.randrange(k) for _ in range(n)]
            if n > 3 and r.random() < 0.5:
                a, p = r.randrange(n), r.randrange(1, n)
                w = [w[a + (i - a) % p] if i >= a and a + (i - a) % p < n else w[i] for i in range(n)]
            if r.random() < 0.2:  # Fibonacci words have runs inside runs
                u, v = [b"a"], [b"a", b"b"]
                while len(v) < n:
                    u, v = v, v + u
                w = v[:n]
            texts.append(w)
        assert periods.Words(texts).runs() == [all_runs(w) for w in texts]


def test_equal_codes_of_different_words():
    """More words than the bound on codes at the greatest scale: seeds by chance are compared and left out."""
    n = 70_000
    w = [b"%d" % (k % 33_000) for k in range(n)]
    assert periods.Words([w]).runs() == [[(0, n, 33_000)]]
    w[40_000] = b"other"
    assert periods.Words([w]).runs() == [[]]  # 33,000 words stand twice, but no stretch of two periods is left


def test_one_word_and_many_periods():
    assert periods.Words([[b"a"] * 50_000]).runs() == [[(0, 50_000, 1)]]
    w = ([b"a"] * 12 + [b"b"] * 13) * 40
    expected = sorted([(25 * k, 12, 1) for k in range(40)] + [(25 * k + 12, 13, 1) for k in range(40)] + [(0, 1000, 25)])
    assert periods.Words([w]).runs() == [expected]


def test_periods_query_equals_brute_force(spark, tmp_path):
    r = random.Random(3)
    texts = [*TEXTS[:8], *TEXTS[9:], *(" ".join(r.choice("abcdefgh") for _ in range(r.randrange(0, 90))) for _ in range(200)), "α β\tγ\n" * 9, "a b " * 5, "a b " * 6]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in periods.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        w = (t or "").encode().split()
        h, n = zlib.crc32(str(k).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = all_runs(w)
        top = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
        x = got[k]
        assert (x.n_runs, x.start, x.length, x.period) == (len(runs), *top), k
        assert x.exponent_milli == (1000 * top[1] // top[2] if runs else None)
        assert x.runs_sha256 == sha("".join(f"{a},{b},{c}\n" for a, b, c in runs))
        assert x.collapsed_sha256 == sha(b" ".join(dropped(w, runs)))


def test_periods_general_interface(spark):
    out = {r.doc_id: r for r in periods.periodic_runs(frame(spark, TEXTS)).collect()}
    assert [tuple(x) for x in out[10].runs] == [(0, 40, 2)] == [tuple(x) for x in out[11].runs] and out[10].collapsed == "de la"
    assert [tuple(x) for x in out[8].runs] == [(0, 40_000, 977)] and out[0].runs == [] and out[0].best is None and out[0].collapsed == ""
    assert periods.periodic_runs(frame(spark, [])).count() == 0
    twice = periods.periodic_runs(frame(spark, ["a " * 12] * 2, ids=[None, None])).collect()
    assert [r.best.length for r in twice] == [12, 12]


# mixing


def shared_out(sizes, weights, total, most=2):
    """Targets by handing the excess on, one round after the other."""
    goal, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    left = total
    while open_ and left > 1e-9:
        w = sum(weights[s] for s in open_)
        for s in open_:
            goal[s] += left * weights[s] / w
        left = 0.0
        for s in list(open_):
            if goal[s] >= most * sizes[s]:
                left += goal[s] - most * sizes[s]
                goal[s] = float(most * sizes[s])
                open_.discard(s)
    return goal


def check_mix(spark, rows):
    df = spark.createDataFrame([(i, t, s, "a", "b", 1, 2, 3, "r", "q") for i, t, s in rows], SCHEMA)
    out = mixing.mixed(df).collect()
    assert len(out) == len(rows)
    assert sorted((str(r.doc_id), r["size"]) for r in out) == sorted((str(i), len((t or "").encode().split())) for i, t, _ in rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").encode().split())
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    goal = shared_out(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(sizes.values()))
    source = {i: s for i, _, s in rows}
    taken = Counter()
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(goal[s])
        assert r.taken == r["size"] * r.copies and r.copies in (0, 1, 2)
        taken[s] += r.taken
    assert sorted(map(str, mixing.mixed(df.repartition(5)).collect())) == sorted(map(str, out))
    return goal, taken, out


def reachable(sizes, most=2):
    sums = {0}
    for n in sizes:
        sums |= {x + n * k for x in sums for k in range(1, most + 1)}
    return sums


def test_mix_is_as_near_as_any(spark):
    r = random.Random(11)
    rows, k = [], 0
    for s in ["é", "b", None, "a", "", "Z"]:
        for _ in range(r.randrange(1, 12)):
            rows.append((k, r.choice([None, "", "w " * r.randrange(1, 60), "w\t" * 40]), s))
            k += 1
    goal, taken, out = check_mix(spark, rows)
    for s, g in goal.items():
        every = reachable([len((t or "").split()) for _, t, x in rows if x == s])
        assert abs(taken[s] - g) <= min(abs(x - g) for x in every) + 1e-6


def test_mix_of_a_hot_source_with_copies(spark):
    r = random.Random(2)
    rows = [(k, "same text of copies " * 8, "hot") for k in range(900)] + [(900 + k, "w " * r.randrange(0, 300), r.choice(["x", "y", None, "hot"])) for k in range(900)]
    goal, taken, out = check_mix(spark, rows)
    assert all(abs(taken[s] - g) < 1 for s, g in goal.items())
    copies = Counter(x.copies for x in out if x.doc_id < 900)
    assert max(copies) - min(copies) <= 1  # documents of one size are taken as evenly as can be


def test_fit_is_even_over_sizes():
    r = np.random.default_rng(0)
    sizes, counts = np.arange(1, 3000), r.integers(1, 2000, 2999)
    total = int((sizes * counts).sum())
    for part in (0.1, 0.73, 1.0, 1.6, 2.0):
        taken = mixing.fitted(sizes, counts, total * part)
        assert abs(int((taken * sizes).sum()) - total * part) <= 0.5 and (taken <= 2 * counts).all()
        many = counts > 500
        assert np.abs(taken[many] / counts[many] - part).max() < 0.07


def test_sums_that_nothing_hits():
    taken, away = mixing.nearest_sum(np.array([6, 10]), np.array([3, 2]), 15.0)
    assert (int((taken * [6, 10]).sum()), away) == (16, 1.0)
    taken, away = mixing.nearest_sum(np.array([10]), np.array([3]), 15.0)
    assert (int(taken[0]) * 10, away) == (10, 5.0)  # of two sums equally near the smaller one
    assert mixing.nearest_sum(np.array([0, 50]), np.array([5, 5]), 10.0)[0].tolist() == [0, 0]


def test_mix_of_odd_tables(spark):
    assert mixing.mixed(frame(spark, [])).count() == 0
    assert [tuple(r)[1:] for r in mixing.mixed(frame(spark, [None, "", " "], ["a", None, "a"])).collect()] == [(0, 0, 0.0, 0, 0)] * 3
    same = [(None, "a b c", "s")] * 4 + [(7, "a b", "s")] * 3
    df = spark.createDataFrame([(i, t, s, "a", "b", 1, 2, 3, "r", "q") for i, t, s in same], SCHEMA)
    assert sum(r.taken for r in mixing.mixed(df).collect()) == 27  # 1.5 times 18
