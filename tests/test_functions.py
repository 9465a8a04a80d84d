"""Column functions and predicates on literal cases."""

import pytest
from pyspark.sql import functions as F

from assayer.functions import columns as C
from assayer.functions import quality as Q
from assayer.operators import price


def one(spark, *values, f, schema=None):
    """f of each value, in order."""
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], schema or "k int, v string")
    return [r.x for r in df.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


def test_usable_serial(spark):
    bad = [None, "", "?", "??...", "\\", "KONTROLINIS", "unknown", " n/a ", "- -"]
    assert one(spark, *bad, "8K0-131-701", f=C.usable_serial) == [False] * len(bad) + [True]


def test_serial_forms(spark):
    assert one(spark, "AB 12-34/56.", "ab123456", "a\tb c", None, f=C.normalize_serial) == ["AB123456", "AB123456", "ABC", ""]
    assert one(spark, "a\tb-c", None, f=C.sql_normalize_serial) == ["A\tBC", ""]


def test_numbers(spark):
    assert one(spark, "1 234,5", "1'000", "1d", "NaN", "Infinity", "", None, "-.5e1", f=C.number_cell) == [1234.5, 1000.0, None, None, None, None, None, -5.0]
    assert one(spark, "  a \n b ", "", "=A1", "#REF", None, f=C.clean_text) == ["a b", None, None, None, None]
    assert one(spark, 1.0005, -1.0, 1e9, float("nan"), None, f=lambda c: C.sanitize(c, 8, 3), schema="k int, v double") == [1.001, None, None, None, None]
    assert one(spark, 1.0005, 0.0, None, f=lambda c: C.fixed(c, 12, 3), schema="k int, v double") == ["1.001", "0.000", "null"]


def test_signatures(spark):
    df = spark.createDataFrame([(1.234, 100.0, 200.0, 10.0), (1.2340, 100.0, 200.0, 10.0), (None, 100.0, None, None), (1.0, None, 0.0, None)], "w double, pt double, pd double, rh double")
    r = df.select(C.import_signature(F.lit("g"), F.lit("s 1"), "w", "pt", "pd", "rh").alias("s"), C.fingerprint(F.lit("g"), F.lit("s1"), "w", "pt", "pd", "rh").alias("f")).collect()
    assert r[0].s == r[1].s and r[0].f == r[1].f and r[2].f is None and r[3].f is None
    assert r[2].s == "g|S1|null|100.0000|null|null"


def test_slugs_and_urls(spark):
    assert one(spark, " Foo_Bar  baz!", "123", "--", None, f=C.slug) == ["foo-bar-baz", None, None, None]
    assert one(spark, "https://x.y/carbrand/Some_Brand/?a", "https://x.y/other", None, f=lambda c: C.brand_slug(c, F.lit("12"), F.lit("Fall Back"))) == ["some-brand", "fall-back", "fall-back"]
    assert one(spark, "https://x.y/product/12-ab-c/", "nothing", f=C.product_key) == ["ABC", None]
    assert one(spark, "some_brand-x", f=C.title_from_slug) == ["Some Brand X"]
    assert one(spark, "new  Alpha  beta", "Newport", f=C.sheet_group_name) == ["ALPHA BETA", "NEWPORT"]


def test_serial_families(spark):
    f = lambda name: lambda c: C.serial_families(c, F.lit(name))
    assert one(spark, "KT 1128", f=f("KT 1128")) == [["KT1128"]]
    assert one(spark, "038253031H 038178BA", f=f("038178BA 038253031H")) == [["038253031H038178BA", "038253031H", "038178BA"]]
    assert one(spark, "GM10200 8K0131701", f=f("GM10200")) == [["GM102008K0131701", "GM10200", "8K0131701"]]
    assert one(spark, "AB 12", f=f("AB")) == [["AB12"]]


def test_codes_and_headers(spark):
    assert one(spark, "EX1/EX2", "a; A ,b||", None, f=C.split_codes) == [["EX1", "EX2"], ["a", "b"], []]
    assert one(spark, "Serial Code", "Произв.", "Piece kg", "Pt", "Extra Codes", "Pd total", "x", f=C.header_role) == ["serial", "model", "weight", "pt", "extra_codes", "pd", None]
    assert one(spark, "<p>&nbsp;</p>", " <b>x</b> ", None, f=C.blank_after_markup) == [None, "<b>x</b>", None]


def test_versions(spark):
    got = one(spark, "1.9.9", "2.3.0", "2.5", f=lambda c: C.update_state(c, F.lit("2.0.0"), F.lit("2.5.0")))
    assert [(r.required, r.available) for r in got] == [(True, True), (False, True), (False, False)]


def test_quotes(spark):
    bodies = ['{"price": 9, "bid": 10.5}', '{"results": [{"bid": "11", "change_pct": 2}]}', '{"data": {"quote": {"bid": 12}}}', '{"bid": -1}', "broken"]
    assert one(spark, *bodies, f=C.quote_bid) == [10.5, 11.0, 12.0, None, None]
    assert one(spark, *bodies[:2], f=C.quote_change_pct) == [0.0, 2.0]


def test_issues(spark):
    rows = [("S1", "M", 1.0, 5.0, "5"), ("?", "M", 1.0, 5.0, "5"), ("KONTROLINIS 1", "M", 1.0, 5.0, "5"), ("S1", "M", None, 5.0, "5"), ("S1", "M", 1.0, 0.0, "0"), ("S1", "M", 1.0, None, "100/200"), (" ", "M", 1.0, 5.0, "5"), ("S1", " ", 1.0, 5.0, "5")]
    df = spark.createDataFrame(rows, "s string, m string, w double, pt double, raw string").withColumn("n", F.lit(None).cast("double"))
    got = [r.x for r in df.select(Q.issue_code("s", "m", "w", "pt", "n", "n", raw=("raw", F.lit(""), F.lit(""))).alias("x")).collect()]
    assert got == [None, "invalid_serial_code", "control_row", "missing_or_invalid_weight", "missing_assay_values", "ambiguous_assay_value", "missing_serial_code", "missing_model"]


def test_prices(spark):
    items = spark.createDataFrame([(1, 1.0, 1000.0, 500.0, 250.0), (2, 2.0, 1000.0, 500.0, 250.0), (3, None, 1.0, 1.0, 1.0)], "k int, weight_kg double, pt_ppm double, pd_ppm double, rh_ppm double")
    spot = spark.createDataFrame([(311.04, 622.07, 933.11)], "pt_oz double, pd_oz double, rh_oz double")
    assert [r.price for r in price.priced(items, spot, 0.8).orderBy("k").collect()] == [22.0, 44.0, 0.0]
    heavy = spark.createDataFrame([(6.649, 2750.0, None, None)], "weight_kg double, pt_ppm double, pd_ppm double, rh_ppm double")
    pt = spark.createDataFrame([(1432.51, None, None)], "pt_oz double, pd_oz double, rh_oz double")
    assert price.priced(heavy, pt, 0.8).first().price == 673.68
    assert [r.price for r in price.priced(items, spot.limit(0)).collect()] == [0.0] * 3


def test_estimates(spark):
    schema = "weight double, weight_unit string, pt_ppm double, pd_ppm double, rh_ppm double, pt_usd_per_gram double, pd_usd_per_gram double, rh_usd_per_gram double, pt_rate double, pd_rate double, rh_rate double, humidity_rate double"
    rows = [(100.0, "kg", 100.0, 100.0, 100.0, 67.93, 46.94, 305.43, 98.0, 98.0, 90.0, 50.0), (182.0, "g", 120.0, 350.0, 12.0, 64.17, 45.30, 303.82, 0.0098, 0.0098, 0.009, 5.0)]
    assert [r.total_usd for r in price.estimate(spark.createDataFrame(rows, schema)).collect()] == [1937.3, 4.56]


def test_image_rules(spark):
    df = spark.createDataFrame([(3, 0, 0.0, 0.0, 0.0), (9, 2, 40.0, 20.0, 0.5), (9, 0, 25.0, 0.0, 0.2), (None, 0, 5.0, 0.0, 0.9)], "d int, f int, c double, s double, m double")
    assert [r.v.verdict for r in df.select(Q.image_verdict("d", "f", "c", "s", "m").alias("v")).collect()] == ["spam_hash", "spam_face", "wrong_mark", None]
    marks = spark.createDataFrame([([0.83],), ([0.7, 0.63],), ([0.7, 0.5],), ([],)], "s array<double>")
    assert [r.x for r in marks.select(Q.marked("s").alias("x")).collect()] == [True, True, False, False]


@pytest.mark.parametrize("text, key", [("file10", "file" + "10".zfill(20)), ("File2b", "file" + "2".zfill(20) + "b")])
def test_natural_key(spark, text, key):
    assert one(spark, text, f=C.natural_key) == [key]
