"""Secret scans: fixed patterns, and a battery of randomness tests.  DataFrame functions only.

Base patterns (leftmost non-overlapping matches of each, failing ones dropped):
assign (a key word, a sign, a value of 6 or more characters), access (AKIA and capitals
or digits, 20 or more) and hex (24 or more digits in lower case).

The battery looks at every other run of ``LEAST`` or more base-64 characters: base spans are
cut out of the maximal runs, and what is left on either side of them is a run of its own.
Its encoding is the smallest alphabet that holds it.

Randomness: over that alphabet a chi-squared test of uniform use, a runs test around the middle of
the alphabet and a serial-correlation test at lag one are made, and p = min(1, 3 * least p).
A run with p < ``REJECTED`` is not random and is never reported: repeated alphabets, counters,
words with a pattern.

False discoveries: the null of a run is that it is ordinary text (a word, a name, a path, a
number), whose characters repeat more often than random ones.  For each encoding ``COLLIDE`` has
the probability that two characters of ordinary strings are equal, as stated; ``measured`` scales it by
what the texts show.  The scale of an encoding is the median, over the runs of all other encodings,
of the share of equal pairs relative to ``COLLIDE``: secrets of one encoding cannot move
their own null, and fewer than half of all runs move no median far.  ``TRUST`` runs are added
that are as stated, so that few runs change little.  The chi-squared
statistic of ordinary text of n characters then has a mean that lies (n - 1) (k c - 1) above that of
random strings, so that q, the probability of a statistic as small as the one found, falls with
the length: a short run cannot be told from a word, a long one can.  The q of all runs
of all lengths and encodings are pooled, and the Benjamini-Hochberg rule sets the threshold at
which at most ``fdr`` of the reported runs are expected to be ordinary text.  It works on
a histogram of q with a fixed number of cells over all rows, and takes the upper end of a cell
for all in it.  Classes with few runs need no rule of their own, since the null is not estimated
from them.  ``false_share`` tells which share of the reported runs the null expects to be ordinary.

Offsets count code points, ends are exclusive.  Null and empty texts have no spans.  Rows are
handled one by one but for the histogram, repeated rows too; extra columns are kept as they are, names
beginning with ``_secret`` excepted: these are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, table

#: The patterns of the contract.
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
#: The same for kinds whose matches have the least length as a condition of their own.
SEARCHED = {"assign": PATTERNS["assign"], "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
KINDS = ["assign", "access", "hex", "random"]
LEAST = 16
TOKEN = rf"[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}"

_D, _U = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Alphabets in the order in which they are tried, with their pattern.
ALPHABETS = {
    "digits": (_D, "0-9"),
    "hex": (_D + "abcdef", "0-9a-f"),
    "HEX": (_D + "ABCDEF", "0-9A-F"),
    "lower": (_U.lower(), "a-z"),
    "upper": (_U, "A-Z"),
    "base36": (_D + _U.lower(), "0-9a-z"),
    "BASE36": (_D + _U, "0-9A-Z"),
    "letters": (_U + _U.lower(), "A-Za-z"),
    "base62": (_D + _U + _U.lower(), "0-9A-Za-z"),
    "base64": (_D + _U + _U.lower() + "+/", "0-9A-Za-z+/"),
}
#: How often two characters of ordinary strings of an encoding are equal (prose: 0.065 and more).
COLLIDE = {"digits": 0.15, "hex": 0.11, "HEX": 0.11, "lower": 0.065, "upper": 0.065, "base36": 0.06, "BASE36": 0.06, "letters": 0.06, "base62": 0.055, "base64": 0.055}
#: The share of equal triples of characters, relative to the square of the share of equal pairs (prose: 1.3).
TRIPLES = 1.3
REJECTED = 0.01
#: Cells of the histogram of q: tenths of a power of ten.
CELLS = 150
#: Runs as stated that are added to those found when the null is measured, and cells for a factor of one.
TRUST, FACTOR_CELLS = 100, 64
_OPEN, _CLOSE, _PLAIN = "", "", ""
_STEP = 256


def spans(text: Column, kind: str, pattern: str, least: int = 0) -> Column:
    """Array of (start, rank, end, kind, value) of the matches of ``pattern``.

    Matches are marked with two private characters (those of the text itself are first
    replaced, one for one), the text is split there, and lengths are summed up, in
    steps so that many matches in a long text stay cheap.
    """
    clean = F.when(text.contains(_OPEN) | text.contains(_CLOSE), F.translate(text, _OPEN + _CLOSE, _PLAIN + _PLAIN)).otherwise(text)
    two = "$2" if kind == "assign" else ""
    parts = F.split(F.regexp_replace(clean, pattern, f"{_OPEN}$0{_CLOSE}{two}{_CLOSE}"), _OPEN)
    rank = F.lit(KINDS.index(kind))
    span = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"
    none = F.from_json(F.lit("[]"), span)
    start = F.struct(F.lit(0).alias("pos"), none.alias("out"))

    def one(acc, part):
        bits = F.split(part, _CLOSE)
        size, found = F.length(bits[0]), F.size(bits) == 3
        hit = F.struct(acc["pos"].alias("start"), rank.alias("rank"), (acc["pos"] + size).alias("end"), F.lit(kind).alias("kind"), bits[0].alias("value"))
        good = found & (F.length(bits[1]) >= least) if least else found
        return F.struct(
            (acc["pos"] + size + F.when(found, F.length(bits[2])).otherwise(0)).alias("pos"),
            F.when(good, F.concat(acc["out"], F.array(hit))).otherwise(acc["out"]).alias("out"),
        )

    def shifted(acc, group):
        moved = F.transform(group["out"], lambda s: F.struct((s["start"] + acc["pos"]).alias("start"), s["rank"].alias("rank"), (s["end"] + acc["pos"]).alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
        return F.struct((acc["pos"] + group["pos"]).alias("pos"), F.concat(acc["out"], F.array(moved)).alias("out"))

    nested = F.struct(F.lit(0).alias("pos"), F.from_json(F.lit("[]"), f"array<{span}>").alias("out"))

    def stepped(all_parts):
        groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_parts) - 1) / _STEP).cast("int")), lambda k: F.aggregate(F.slice(all_parts, k * _STEP + 1, F.lit(_STEP)), start, one))
        return F.flatten(F.aggregate(groups, nested, shifted)["out"])

    # a one-element array gives the parts a name, so that they are computed once
    return F.transform(F.array(parts), stepped)[0]


def _upper_tail(z: Column) -> Column:
    """1 - Phi(z), by the rational approximation of Abramowitz and Stegun 26.2.17."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def encoding(value: Column) -> Column:
    out = F.lit("base64")
    for name, (_, kind) in reversed(ALPHABETS.items()):
        out = F.when(value.rlike(f"^[{kind}]+$"), F.lit(name)).otherwise(out)
    return out


def _by_encoding(name: Column, values: dict) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), name)


def ordinary(squares: Column, n: Column, k: Column, c: Column) -> Column:
    """The probability that ordinary text of ``n`` characters, two of which are equal with probability ``c``, is as even as ``squares`` tells."""
    # mean and variance of the number of equal pairs, scaled as chi-squared is
    above = (n - 1) * (k * c - 1)
    spread = k / n * F.sqrt(4 * n * (n - 1) * (n - 2) * (TRIPLES - 1) * c * c + 2 * n * (n - 1) * (c - c * c))
    return _upper_tail((k - 1 + above - (squares * k / n - n)) / spread)


def battery(value: Column) -> Column:
    """(encoding, n, p, q, squares) of a string of base-64 characters: p that it is random, q that it is ordinary text.

    ``squares`` is the sum of the squares of the numbers of each character.
    """
    body = F.translate(F.rtrim(F.translate(value, "=", " ")), "-_", "+/")
    name = encoding(body)
    alphabet = _by_encoding(name, {k: letters for k, (letters, _) in ALPHABETS.items()})
    collide = _by_encoding(name, COLLIDE)

    def tested(s):
        n, k, codes = s["n"].cast("double"), s["k"], s["codes"]
        squares = F.aggregate(F.sequence(F.lit(0), k - 1), F.lit(0.0), lambda a, c: a + F.pow(F.size(F.filter(codes, lambda x: x == c)).cast("double"), F.lit(2.0)))
        chi, df = squares * k / n - n, k - 1
        w = 2 / (9 * df)
        p_chi = _upper_tail((F.pow(F.greatest(chi, F.lit(1e-9)) / df, F.lit(1 / 3)) - (1 - w)) / F.sqrt(w))
        high = F.size(F.filter(codes, lambda x: x * 2 >= k)).cast("double")
        low = n - high
        steps = F.zip_with(F.slice(codes, F.lit(2), s["n"] - 1), F.slice(codes, F.lit(1), s["n"] - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        runs = 1 + F.size(F.filter(steps, lambda t: (t["a"] * 2 >= k) != (t["b"] * 2 >= k)))
        mean = 1 + 2 * high * low / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = F.when(var > 0, 2 * _upper_tail(F.abs(runs - mean) / F.sqrt(var))).otherwise(F.lit(0.0))
        m = F.aggregate(codes, F.lit(0.0), lambda a, c: a + c) / n
        v = F.aggregate(codes, F.lit(0.0), lambda a, c: a + (c - m) * (c - m))
        lagged = F.aggregate(steps, F.lit(0.0), lambda a, t: a + (t["a"] - m) * (t["b"] - m))
        p_serial = F.when(v > 0, 2 * _upper_tail(F.abs((lagged / v) + 1 / n) * F.sqrt(n))).otherwise(F.lit(0.0))
        q = ordinary(squares, n, k, s["collide"])
        return F.struct(s["name"].alias("encoding"), s["n"].alias("n"), F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial)).alias("p"), q.alias("q"), squares.alias("squares"))

    def coded(s):
        codes = F.transform(F.sequence(F.lit(1), F.length(s["body"])), lambda k: F.instr(s["alphabet"], F.substring(s["body"], k, F.lit(1))) - 1)
        return F.struct(s["name"].alias("name"), F.length(s["body"]).alias("n"), F.length(s["alphabet"]).alias("k"), s["collide"].alias("collide"), codes.alias("codes"))

    first = F.array(F.struct(name.alias("name"), body.alias("body"), alphabet.alias("alphabet"), collide.alias("collide")))
    return F.transform(F.transform(first, coded), tested)[0]


def cell(test: Column) -> Column:
    """Cell of the histogram: the least power of ten (in tenths) that q does not exceed; the first one if the run is not random."""
    power = F.floor(-10 * F.log10(F.greatest(test["q"], F.lit(1e-300))))
    return F.when(test["p"] < REJECTED, 0).otherwise(F.least(F.greatest(power, F.lit(0)), F.lit(CELLS - 1))).cast("int")


def _rests(token: Column, base: Column) -> Column:
    """The stretches of ``LEAST`` or more characters of ``token`` outside the base spans, which are in order of their start."""
    touching = F.filter(base, lambda b: (b["start"] < token["end"]) & (token["start"] < b["end"]))
    start = F.struct(token["start"].alias("pos"), F.from_json(F.lit("[]"), "array<struct<start:int,end:int>>").alias("out"))

    def rest(pos, end):
        return F.when(end - pos >= LEAST, F.array(F.struct(pos.alias("start"), end.alias("end")))).otherwise(F.from_json(F.lit("[]"), "array<struct<start:int,end:int>>"))

    def cut(acc, b):
        return F.struct(F.greatest(acc["pos"], b["end"]).alias("pos"), F.concat(acc["out"], rest(acc["pos"], b["start"])).alias("out"))

    left = F.aggregate(touching, start, cut, lambda acc: F.concat(acc["out"], rest(acc["pos"], token["end"])))
    part = lambda s: F.struct(s["start"].alias("start"), token["rank"].alias("rank"), s["end"].alias("end"), token["kind"].alias("kind"), F.substring(token["value"], s["start"] - token["start"] + 1, s["end"] - s["start"]).alias("value"))
    return F.transform(left, part)


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with _secret_base (spans of the patterns) and _secret_tested (candidates of the battery)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = F.concat(spans(text, "assign", SEARCHED["assign"], 6), spans(text, "access", SEARCHED["access"]), spans(text, "hex", SEARCHED["hex"]))
    tokens = F.when(text.rlike(TOKEN), spans(text, "random", TOKEN))
    df = docs.withColumn("_secret_base", F.array_sort(base)).withColumn("_secret_tokens", F.coalesce(tokens, F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>")))
    other = F.when(F.size("_secret_base") == 0, F.col("_secret_tokens")).otherwise(F.flatten(F.transform("_secret_tokens", lambda t: _rests(t, F.col("_secret_base")))))
    tested = F.transform(other, lambda t: F.struct(t["start"].alias("start"), t["rank"].alias("rank"), t["end"].alias("end"), t["kind"].alias("kind"), battery(t["value"]).alias("test")))
    bare = F.transform("_secret_base", lambda t: F.struct(t["start"].alias("start"), t["rank"].alias("rank"), t["end"].alias("end"), t["kind"].alias("kind")))
    return df.withColumn("_secret_tested", tested).withColumn("_secret_base", bare).drop("_secret_tokens")


def levels(scanned: DataFrame) -> dict[str, float]:
    """For each encoding, how often characters of ordinary runs are equal, relative to ``COLLIDE``; from the runs of all other encodings."""
    test = F.col("c.test")
    share = (test["squares"] - test["n"]) / (test["n"] * (test["n"] - 1.0)) / _by_encoding(test["encoding"], COLLIDE)
    at = F.least(F.floor(share * FACTOR_CELLS), F.lit(4 * FACTOR_CELLS)).cast("int")
    counts = scanned.select(F.explode("_secret_tested").alias("c")).select(test["encoding"].alias("encoding"), at.alias("cell")).groupBy("encoding", "cell").count().collect()  # as many rows as encodings and cells at most
    out = {}
    for name in COLLIDE:
        bins = [0] * (4 * FACTOR_CELLS + 1)
        for r in counts:
            bins[r["cell"]] += r["count"] * (r["encoding"] != name)
        n, below = sum(bins), 0
        median = 1.0
        for k, size in enumerate(bins):
            if 2 * (below + size) >= n and size:
                median = (k + (n / 2 - below) / size) / FACTOR_CELLS
                break
            below += size
        out[name] = (TRUST + n * median) / (TRUST + n)
    return out


def measured(scanned: DataFrame) -> DataFrame:
    """``scanned`` with the q of every run by the null that the texts themselves show (see ``levels``)."""
    scale = levels(scanned)
    collide = {name: max(c * scale[name], 1 / len(ALPHABETS[name][0])) for name, c in COLLIDE.items()}  # ordinary text is never more even than random strings

    def again(t):
        test, n = t["test"], t["test"]["n"].cast("double")
        size = _by_encoding(test["encoding"], {name: len(letters) for name, (letters, _) in ALPHABETS.items()})
        return t.withField("test", test.withField("q", ordinary(test["squares"], n, size, _by_encoding(test["encoding"], collide))))

    return scanned.withColumn("_secret_tested", F.transform("_secret_tested", again))


def _cells(scanned: DataFrame) -> list[int]:
    """The number of runs in each cell."""
    at = cell(F.col("c.test"))
    counts = scanned.select(F.explode("_secret_tested").alias("c")).select(at.alias("cell")).groupBy("cell").count().collect()  # CELLS rows at most
    bins = [0] * CELLS
    for r in counts:
        bins[r["cell"]] += r["count"]
    return bins


def false_share(scanned: DataFrame, first: int | None) -> float | None:
    """The share of the runs from cell ``first`` on that the null expects to be ordinary text; none if none is reported."""
    bins = _cells(scanned)
    reported = sum(bins[first:]) if first is not None else 0
    return min(1.0, sum(bins) * 10 ** (-first / 10) / reported) if reported else None


def threshold(scanned: DataFrame, fdr: float = 0.1) -> int | None:
    """The first cell to report, by Benjamini and Hochberg over the runs of all rows; none if nothing can be reported."""
    bins = _cells(scanned)
    total, above, first = sum(bins), 0, None
    for k in range(CELLS - 1, 0, -1):
        above += bins[k]
        if above and total * 10 ** (-k / 10) <= fdr * above:
            first = k
    return first


def found(scanned: DataFrame, first: int | None) -> DataFrame:
    """``scanned`` with _secrets: all spans in order, the runs from cell ``first`` on among them."""
    random = F.filter("_secret_tested", lambda t: cell(t["test"]) >= first if first is not None else F.lit(False))
    plain = F.transform(random, lambda t: F.struct(t["start"].alias("start"), t["rank"].alias("rank"), t["end"].alias("end"), t["kind"].alias("kind")))
    return scanned.withColumn("_secrets", F.array_sort(F.concat("_secret_base", plain)))


def redacted(with_secrets: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Every maximal run of reported characters replaced by ``mark``."""
    none = F.from_json(F.lit("[]"), "array<struct<start:int,end:int>>")
    runs = F.aggregate(
        "_secrets",
        none,
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["end"]),
            F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    text = F.col(text_col)
    cuts = F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))), runs, F.array(F.struct(F.length(text).alias("start"), F.length(text).alias("end"))))

    def joined(c):
        pieces = F.transform(F.sequence(F.lit(2), F.size(c)), lambda k: F.substring(text, F.element_at(c, k - 1)["end"] + 1, F.element_at(c, k)["start"] - F.element_at(c, k - 1)["end"]))
        return F.array_join(pieces, mark)

    return with_secrets.withColumn(text_col, F.when(F.size("_secrets") > 0, F.transform(F.array(cuts), joined)[0]).otherwise(text))


def _listed(column: str) -> Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    scanned = measured(saved(scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")))
    rows = found(scanned, threshold(scanned))
    n = lambda kind: F.size(F.filter("_secret_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(_listed("_secret_base").cast("binary"), 256).alias("base_sha256"), _listed("_secrets").alias("spans"))
