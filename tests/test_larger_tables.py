"""Steps whose work must not grow faster than the tables, held against plain forms of the same results."""

import random

import pytest
from pyspark.sql import functions as F

from assayer.functions import columns as C
from assayer.operators import dedupe, match, neighbours, rank, report, search, textindex
from assayer.plans import jobs, queries
from assayer.sources import shared


def planned(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_separators_are_those_of_the_pattern(spark):
    """Every code point but surrogates, between two letters."""
    points = spark.range(1, 0x110000).filter("id NOT BETWEEN 55296 AND 57343").withColumn("c", F.expr("concat('a', decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32'), 'b')"))
    pattern = F.coalesce(F.regexp_replace(F.upper("c"), C.SERIAL_SEPARATORS, ""), F.lit(""))
    assert points.filter(C.normalize_serial("c") == "AB").count() == 29
    assert points.filter(C.normalize_serial("c") != pattern).count() == 0
    assert "regexp" not in planned(points.select(C.normalize_serial("c").alias("k"))).lower()


@pytest.mark.parametrize("seed", [1, 2])
def test_media_by_codes_equal_propagate(spark, seed):
    """Items, codes and media of unknown items, repeated codes and blank ones."""
    r = random.Random(seed)
    code = lambda: r.choice([None, "", " - ", "k1", "K-1", "k 2", "k3", "k4", "k5"])
    items = spark.createDataFrame([(f"i{k}", code()) for k in range(40)], "item_id string, serial_code string")
    codes = spark.createDataFrame([(f"i{r.randrange(45)}", code()) for _ in range(50)], "item_id string, code string")
    media = spark.createDataFrame([(r.randrange(1000), f"i{r.randrange(30, 45)}") for _ in range(9)], "media_id long, item_id string")
    keys = items.select("item_id", C.normalize_serial("serial_code").alias("key")).unionByName(codes.join(items.select("item_id"), "item_id").select("item_id", C.normalize_serial("code").alias("key")))
    keys = keys.filter("key <> ''").distinct()
    want = match.propagate(media.join(keys, "item_id"), keys).collect()
    assert want and sorted(match.propagate_by_codes(items, codes, media).collect()) == sorted(want)


def test_fingerprints_are_computed_once(spark):
    rows = spark.createDataFrame([(k, f"g{k % 2}", f"k{k % 3}" if k % 4 else None, 1.0, 2.0, 3.0, 4.0) for k in range(24)], "row_no long, group_id string, serial_code string, weight_kg double, pt_ppm double, pd_ppm double, rh_ppm double")
    fp = C.fingerprint("group_id", "serial_code", "weight_kg", "pt_ppm", "pd_ppm", "rh_ppm")
    found = dedupe.collisions(rows.select("row_no", fp.alias("new_fingerprint")), rows.select("row_no", fp.alias("assay_fingerprint")))
    assert planned(found).count("sha2(") == 2
    held = [(r.row_no, r.f) for r in rows.select("row_no", fp.alias("f")).collect()]
    assert {r.row_no: r.collides for r in found.collect()} == {n: f is not None and any(f == g and n != m for m, g in held) for n, f in held}


def test_empty_fingerprints_do_not_collide(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a"), (5, "b")], "row_no long, f string")
    out = dedupe.collisions(rows.withColumnRenamed("f", "new_fingerprint"), rows.withColumnRenamed("f", "assay_fingerprint"))
    assert {r.row_no: r.collides for r in out.collect()} == {1: False, 2: False, 3: True, 4: True, 5: False}


def test_items_without_analysis_are_spread(spark):
    items = spark.createDataFrame([(1, "a", "b"), (2, "b", None), (3, None, None), (4, None, "a"), (5, "c", "c")], "item_id long, fp string, new_fp string")
    out = match.assay_sources(items, spark.createDataFrame([("a",), ("c",), ("c",), (None,)], "raw_fp string"))
    assert {r.item_id: (r.verified, r.collides) for r in out.collect()} == {1: (True, True), 2: (False, False), 3: (False, False), 4: (False, True), 5: (True, False)}
    joins = [line for line in planned(out).splitlines() if line.strip(" :+-").startswith("Join ")]
    assert len(joins) == 2 and not [j for j in joins if "(fp#" in j]


def test_collisions_after_conversion_decide(spark, tmp_path):
    """An analysis in grams collides once another item holds it in ppm; without that item it is updated."""
    line = "id AS l_orderkey, CAST(1 AS INT) AS l_linenumber, p AS l_partkey, 4L AS l_suppkey, CAST(q AS DOUBLE) AS l_quantity, 0.05D AS l_discount, 0.02D AS l_tax, f AS l_returnflag, TIMESTAMP '1995-01-01' AS l_shipdate"
    # slots are 10 * id + 1, so ids 2 and 5 hold ppm; 1 and 3 are one analysis, that of 2 in grams, and 7 stands nowhere in the source
    rows = [(1, 7, 3, "A"), (2, 7, 3, "N"), (3, 7, 3, "N"), (4, 8, 3, "R"), (5, 9, 3, "A"), (6, 7, 4, "A"), (7, 9, 5, "N")]
    for at, ids, want in (("all", range(8), (7, 4, 3, 2, 2)), ("less", (1, 3, 4, 5, 6, 7), (6, 4, 2, 0, 4))):
        spark.createDataFrame([r for r in rows if r[0] in ids], "id long, p long, q int, f string").selectExpr(*line.split(", ")).write.parquet(str(tmp_path / at / "lineitem.parquet"))
        assert tuple(queries.QUERIES["c29_d22_j10_legacy"](spark, str(tmp_path / at)).select("matched", "verified", "unverified", "collision", "updated").first()) == want


def test_repair_counts_items_once(spark):
    """Numbers of items that stand once are counted, not listed; those that stand twice name one item."""
    schema = "row_no long, group_id string, model string, weight_kg double, shape_code string, details string"
    make = lambda *rows: spark.createDataFrame(list(rows), schema)
    rows = make((1, "g", "m", 1.0, "s", None), (2, "g", "M", None, None, "d"), (3, "h", "m", 1.0, None, None))
    items = make((10, "g", "M", 1.0, "S", "d"), (11, "g", "m", 1.0, "t", "e"), (12, "g", "m", 2.0, "s", None))
    out = match.repair_candidates(rows, items, ["weight_kg", "shape_code"])
    assert "distinct" not in planned(out)
    assert {tuple(r) for r in out.collect()} == {(1, 1, 10), (2, 1, 10), (3, 0, None)}
    twice = items.unionByName(make((10, "g", "M", 1.0, "s", "e")))
    assert {tuple(r) for r in match.repair_candidates(rows, twice, ["weight_kg", "shape_code"]).collect()} == {(1, 1, 10), (2, 1, 10), (3, 0, None)}


def test_repairs_look_candidates_up_once(spark):
    row = lambda n, serial: (n, "g", "m", serial, 1.0, 2.0, 3.0, 4.0, "d")
    schema = "row_no long, group_id string, model string, serial_code string, weight_kg double, pt_ppm double, pd_ppm double, rh_ppm double, details string"
    report = jobs.repair_items(spark.createDataFrame([row(10, "k1")], schema), spark.createDataFrame([row(1, "k2")], schema), ["weight_kg"])["report"]
    assert "_row_mask" not in planned(report)
    assert report.first().updated == 1


@pytest.mark.parametrize("heads,window,frequent", [(0, 2, 1), (100, 1, 50), (100_000, 32, 1000)])
def test_searches_beyond_the_bounds_equal_the_scan(spark, monkeypatch, heads, window, frequent):
    """Many beginnings, searches longer than a window, and few or all texts counted as frequent."""
    for name, n in (("HEADS", heads), ("WINDOW", window), ("FREQUENT", frequent)):
        monkeypatch.setattr(textindex, name, n, raising=False)
    r = random.Random(heads)
    text = lambda n: r.choice([None, "", "".join(r.choice("aB1-. é") for _ in range(r.randrange(0, n)))])
    items = spark.createDataFrame([(f"i{k}", text(9), r.choice(["a", "1-b", text(6)])) for k in range(60)], "item_id string, serial_code string, model string")
    codes = spark.createDataFrame([(f"i{r.randrange(60)}", r.choice(["a.b", text(8)])) for _ in range(80)], "item_id string, code string")
    asked = ["", "-", "a", "A.B", "1-b", "zz", "a.b", *("".join(r.choice("aB1-") for _ in range(r.randrange(1, 5))) for _ in range(12))]
    got = textindex.searched(textindex.text_index(items, codes), spark.createDataFrame(list(enumerate(asked)), "search_id long, text string")).collect()
    assert len(got) == len(set(got))
    want = {(k, x.item_id) for k, t in enumerate(asked) for x in search.text_search(items, codes, t).collect()}
    assert want and {tuple(x) for x in got} == want


def test_searches_write_texts_and_matches_only(spark, monkeypatch):
    """Items are not written, nor lists of letter groups: 40 texts that 1,000 items share make 40 rows, besides the matches."""
    rows = []

    def counting(df, *by):
        out = shared.saved(df, *by)
        rows.append(out.count())
        return out

    monkeypatch.setattr(textindex, "saved", counting)
    items = spark.range(1000).selectExpr("concat('i', id) AS item_id", "concat('KT-', 1000 + id % 20) AS serial_code", "concat('Model ', id % 10) AS model")
    codes = items.select("item_id", F.expr("concat('ALT ', substring(item_id, 2) % 10)").alias("code"))
    asked = spark.createDataFrame([(1, "t-1007"), (2, "lt 3"), (3, "no")], "search_id long, text string")
    got = textindex.searched(textindex.text_index(items, codes), asked).groupBy("search_id").count().collect()
    assert {tuple(x) for x in got} == {(1, 50), (2, 100)}
    assert sum(rows) <= 40 + 2 + 40


def test_white_space_and_signs_are_those_of_the_patterns(spark):
    """Every code point but surrogates, around a letter and alone."""
    points = spark.range(1, 0x110000).filter("id NOT BETWEEN 55296 AND 57343").withColumn("c", F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')"))
    both = points.select("c", F.explode(F.array("c", F.concat("c", F.lit("a b"), "c", "c"))).alias("t"))
    assert both.filter(C.trim("t") != F.regexp_replace("t", r"(?U)^\s+|\s+$", "")).count() == 0
    signs = points.select(F.explode(F.array("c", F.concat(F.lit("?"), "c", F.lit("/")))).alias("t"))
    bare = F.regexp_replace(F.upper("t"), r"(?U)^\s+|\s+$", "")
    assert signs.filter(C.usable_serial("t") != ((bare != "") & ~bare.rlike(r"^[?./_\\\-\s]+$"))).count() == 0
    assert "regexp" not in planned(points.filter(C.usable_serial("c"))).lower() and "rlike" not in planned(points.filter(C.usable_serial("c"))).lower()


def test_audit_makes_families_once(spark):
    r = random.Random(4)
    rows = [(f"i{k}", r.choice(["g", "h", None]), r.choice(["k1", "K-1", "k2", "k3", "k4", "n/a", None, "a|b"]), 1.0, 2.0, 3.0, 4.0) for k in range(14)]
    items = spark.createDataFrame(rows, "item_id string, group_id string, serial_code string, weight_kg double, pt_ppm double, pd_ppm double, rh_ppm double")
    products = spark.createDataFrame([(["K1", "K2"], "p"), (["K3", "K3"], "q"), (["K9"], "q")], "families array<string>, product_url string")
    out = jobs.audit(items, products)["unmatched"]
    fam = {(g, s.upper().replace("-", "")) for _, g, s, *_ in rows if s and s != "n/a"}
    want = {(g, s) for g, s in fam if s not in ("K1", "K2", "K3", "K9") or len([x for x in fam if x[1] == s]) > 1}
    got = [(x.group_id, x.serial) for x in out.collect()]
    assert want and want != fam and len(got) == len(set(got)) and set(got) == want
    assert planned(out).count("LogicalRDD") == 2


@pytest.mark.parametrize("few", [0, 100_000])
def test_links_are_made_once(spark, monkeypatch, few):
    monkeypatch.setattr(report, "FEW", few, raising=False)
    pairs = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2), ("b", 2), (None, 1), (None, 2), ("c", 3)], "key string, target long")
    out = report.ambiguous_links(pairs, "key", "target")
    assert sorted(tuple(x) for x in out.collect()) == [("b", 1), ("b", 2)]
    assert "LogicalRDD" not in planned(out)


@pytest.mark.parametrize("cross", [False, True])
def test_image_candidates_read_items_once(spark, cross):
    """Items with several codes, repeated ones, their own serial among them and codes of unknown items."""
    r = random.Random(9)
    code = lambda: r.choice([None, " - ", "k1", "K-1", "k 2", "k3", "k4"])
    own = {f"i{k}": (r.choice(["g", "h", None]), code()) for k in range(24)}
    more = [(f"i{r.randrange(28)}", code()) for _ in range(40)]
    schema = "item_id string, group_id string, serial_code string, weight_kg double, pt_ppm double, pd_ppm double, rh_ppm double, created_at int"
    items = spark.createDataFrame([(i, g, s, 1.0, 2.0, None, None, 1) for i, (g, s) in own.items()], schema)
    codes = spark.createDataFrame(more, "item_id string, code string")
    imaged = spark.createDataFrame([("i3",), ("i3",), ("i5",)], "item_id string")
    products = [(f"u{n}", f"https://x/{n}.jpg", 1, g, [s]) for n, (g, s) in enumerate([("g", "K1"), ("h", "K1"), ("g", "K2"), ("h", "K3"), ("h", "K9")])]
    out = jobs.image_candidates(items, codes, spark.createDataFrame(products, "product_url string, image_url string, image_count int, group_id string, families array<string>"), imaged=imaged, cross_group=cross)
    form = lambda s: (s or "").upper().replace("-", "").replace(" ", "")
    keys = {i: {form(s)} | {form(c) for j, c in more if j == i} - {""} for i, (_, s) in own.items()}
    n = without = 0
    for *_, g, (s,) in products:
        hit = [form(own[i][1]) for i in own if s in keys[i] and (cross or own[i][0] == g)]
        n += hit.count(s) if len(set(hit) - {""}) > 1 else len(hit)
        without += not hit
    funnel = out["funnel"].first()
    assert n > 5 and (funnel.matched_items, funnel.families_without_items) == (n, without)
    assert planned(out["candidates"]).count("LogicalRDD") == 3


def test_ranges_have_a_bounded_number_of_rows(spark, monkeypatch):
    """However small their bytes are, ranges and dealt blocks aren't put together beyond the bound."""
    monkeypatch.setattr(rank, "RANGE", 20, raising=False)
    monkeypatch.setattr(neighbours, "BLOCK", 8)
    rows = spark.range(260).selectExpr("concat('i', id) AS item_id", "'g' AS group_id", "CAST(id * 7919 % 260 AS double) AS pt_ppm").repartition(3)
    table = rank.ranges(rows, [("pt_ppm", False), ("item_id", False)])
    assert table.before.count() > 8 and table.before.agg(F.max("_n")).first()[0] <= 60
    near = neighbours.similar_items(rows, 2)
    assert near.count() == 520 and near.select(F.spark_partition_id()).distinct().count() > 5
