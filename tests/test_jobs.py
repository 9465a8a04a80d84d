"""Jobs, sources and streams on small inline tables."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from assayer.operators import dedupe, enrich, match, search
from assayer.plans import jobs
from assayer.sources import io
from assayer.streaming import quotes as stream

ITEM = "row_no long, item_id string, group_id string, serial_code string, model string, weight_kg double, pt_ppm double, pd_ppm double, rh_ppm double, shape_code string, details string, created_at string"


def items(spark, *rows):
    return spark.createDataFrame([(k, f"i{k}", "g", *r, f"2024-01-0{k + 1}") for k, r in enumerate(rows)], ITEM)


def cells(spark, sheet, rows):
    data = [("f", 0, sheet, r, c, v) for r, row in enumerate(rows, 1) for c, v in row.items()]
    return spark.createDataFrame(data, io.CELLS)


HEAD = [{1: "Model", 2: "Serial Code", 3: "Piece kg", 11: "Extra Codes", 13: "Details", 17: "Shape Code"}, {4: "Pt", 6: "Pd", 8: "Rh"}, {4: "ppm"}]
GROUPS = "id string, name string, sheet_name string"


def test_import_counters(spark):
    row = lambda s, w="1.1", pt="100", **more: {1: "M", 2: s, 3: w, 4: pt, 6: "200", 8: "10"} | more
    table = cells(spark, "Alpha", [*HEAD, row("SER-100"), row("SER-100", pt="101"), row("SER-100", pt="101"), row("KONTROLINIS"), row("?"), row("SER-2", w=""), {1: "M", 2: "SER-3", 3: "1", 4: "0", 6: "0", 8: "0"}, row("SER-9", pt="100/200")])
    have = items(spark, ("SER 100", "M", 1.1, 100.0, 200.0, 10.0, None, None))
    out = jobs.import_cells(table, have, spark.createDataFrame([("g", "x", "alpha")], GROUPS))
    r = out["report"].first()
    assert (r.inserted, r.skipped, r.invalid, r.flagged) == (1, 2, 5, 0)
    assert sorted(x.issue for x in out["issues"].collect()) == ["ambiguous_assay_value", "control_row", "invalid_serial_code", "missing_assay_values", "missing_or_invalid_weight"]


def test_layout_fallback_units_and_codes(spark):
    filler = [{1: "x"}, {1: "y"}, {1: "z"}]
    plain = cells(spark, "B", [*filler, {1: "M", 2: "S1", 3: "6649", 4: "5", 11: "EX1/EX2"}])
    r = jobs.rows_of_cells(plain, spark.createDataFrame([("g", "b", "b")], GROUPS)).first()
    assert (r.group_id, r.serial_code, r.weight_kg, r.pt_ppm, r.codes) == ("g", "S1", 6.649, 5.0, ["EX1", "EX2"])
    grams = [{1: "Model", 2: "Serial Code", 3: "Piece kg", 4: "=SUM(Kitko!A1)", 6: "x", 8: "y"}, {4: "Pt", 6: "Pd", 8: "Rh"}, {4: "ppm", 6: "ppm", 8: "ppm", 10: "Price US$ Piece"}, {1: "M", 2: "S1", 3: "0.52", 4: "2.157", 6: "1.022"}, {1: "M", 2: "S2", 3: "4305", 4: "0.458", 6: "3.395", 8: "0.425"}]
    got = sorted(jobs.rows_of_cells(cells(spark, "C", grams), spark.createDataFrame([("g", "c", "c")], GROUPS)).select("weight_kg", "pt_ppm", "pd_ppm", "rh_ppm").collect())
    assert [tuple(x) for x in got] == [(0.52, 2157.0, 1022.0, None), (4.305, 458.0, 3395.0, 0.425 * 1000)]
    skipped = cells(spark, "Лист 1", [{1: "x"}]).unionByName(cells(spark, "D", [{1: " "}]))
    assert jobs.rows_of_cells(skipped, spark.createDataFrame([], GROUPS)).count() == 0


def test_enrich(spark):
    one = items(spark, ("S1", "M", None, None, None, None, None, None), ("S2", "M", 1.0, 1.0, 1.0, 1.0, "X", None), ("S3", "M", 6649.0, 1.0, None, None, None, None), ("S4", "M", 1.0, 1.0, None, None, None, None), ("S4", "M", 2.0, 1.0, None, None, None, None))
    rows = items(spark, ("S1", "M", 1.234, 150.5, 220.25, 12.75, "SHAPE-X", None), ("S2", "M", 9.0, 9.0, 9.0, 9.0, "Y", None), ("S3", "M", 1.65, 2.0, None, None, None, None), ("S4", "M", 3.0, None, None, None, None, None), ("S5", "M", 3.0, None, None, None, None, None)).withColumn("file", F.lit("f"))
    out = jobs.enrich_items(one, rows, ["row_no"])
    assert {r.serial: r.outcome for r in out["rows"].collect()} == {"S1": "updated", "S2": "noop", "S3": "updated", "S4": "ambiguous", "S5": "created"}
    assert {r.serial: r.after_weight_kg for r in out["rows"].collect()} == {"S1": 1.234, "S2": 1.0, "S3": 1.65, "S4": None, "S5": 3.0}


def test_progressive_fill_equals_a_fold(spark):
    import random

    r = random.Random(1)
    have, rows = [], []
    for k in range(150):
        if r.random() < 0.6:
            have.append((f"s{k}", r.choice([None, 1.0, 99.0]), r.choice([None, 5.0])))
        rows += [(f"s{k}", n, r.choice([None, 2.0, 60.0, 3.0]), r.choice([None, 7.0])) for n in range(r.randint(1, 4))]
    got = enrich.progressive_fill(spark.createDataFrame(have, "s string, weight_kg double, pt double"), spark.createDataFrame(rows, "s string, n int, weight_kg double, pt double"), ["s"], ["n"], ["weight_kg", "pt"])
    state, expected = {s: [w, p] for s, w, p in have}, {}
    for s, n, w, p in rows:
        if s not in state:
            state[s], outcome = [w, p], "created"
        else:
            old = list(state[s])
            if old[0] is None or (old[0] > 50 and w is not None and 0 < w <= 50):
                state[s][0] = w if w is not None else old[0]
            if old[1] is None:
                state[s][1] = p
            outcome = "updated" if state[s] != old else "noop"
        expected[s, n] = (outcome, *state[s])
    assert {(x.s, x.n): (x.outcome, x.after_weight_kg, x.after_pt) for x in got.collect()} == expected


def test_repair_collision(spark):
    have = items(spark, ("S1", "M", 1.0, 5.0, None, None, None, None), ("S2", "M", 1.0, 5.0, None, None, "Z", None))
    rows = items(spark, ("S2", "m", 1.0, 5.0, None, None, None, None)).withColumn("row_no", F.lit(77).cast("long"))
    only = have.filter("serial_code = 'S1'")
    assert jobs.repair_items(only, rows, ["weight_kg", "pt_ppm"])["report"].first().asDict()["updated"] == 1
    assert jobs.repair_items(have, rows, ["weight_kg", "pt_ppm"])["report"].first().asDict()["ambiguous"] == 1


def test_categories_and_fallback(spark):
    things = spark.createDataFrame([(1, "AUDI", []), (2, "BMW", []), (3, "FIAT", [])], "item_id int, brand_key string, tokens array<string>")
    cats = spark.createDataFrame([("a", "AUDI", []), ("b", "BMW", []), ("c", "BMW", [])], "group_id string, key string, tokens array<string>")
    assert {r.item_id: r.group_id for r in jobs.link_categories(things, cats, "none").collect()} == {1: "a", 2: "none", 3: "none"}


def test_search(spark):
    have = items(spark, ("KT 1128", "M", 1.0, 5.0, None, None, None, None), ("X9", "M", 1.0, 5.0, None, None, None, None))
    codes = spark.createDataFrame([("i1", "ALT-GM10")], "item_id string, code string")
    for text in ("KT1128", "KT-1128", "kt.1128", "KT/1128"):
        assert [r.item_id for r in search.text_search(have, codes, text).collect()] == ["i0"], text
    assert search.text_search(have, codes, "---").count() == 0
    assert [r.item_id for r in search.text_search(have, codes, "gm10").collect()] == ["i1"]
    more = items(spark, ("GM10-ABC", "M", 1.0, 5.0, None, None, None, None))
    assert [r.code for r in search.suggestions(more, codes, "GM10").collect()] == ["GM10-ABC", "ALT-GM10"]
    with pytest.raises(ValueError):
        search.sorted_by(have, "price")


def test_candidates_and_ambiguity(spark):
    have = items(spark, ("P1", "M", 1.0, 5.0, None, None, None, None), ("P2", "M", 1.0, 5.0, None, None, None, None))
    codes = spark.createDataFrame([("i0", "CAT-123"), ("i1", "cat 123")], "item_id string, code string")
    schema = "product_url string, image_url string, image_count int, group_id string, families array<string>"
    feed = spark.createDataFrame([("u", "https://x/1.jpg", 1, "g", ["CAT123"])], schema)
    assert jobs.image_candidates(have, codes, feed)["candidates"].count() == 0
    assert jobs.image_candidates(have, codes.limit(1), feed)["candidates"].count() == 1
    exact = items(spark, ("CAT 123", "M", 1.0, 5.0, None, None, None, None), ("P2", "M", 1.0, 5.0, None, None, None, None))
    assert [r.item_id for r in jobs.image_candidates(exact, codes, feed)["candidates"].collect()] == ["i0"]


def test_candidate_funnel(spark):
    fine, bare = (1.0, 5.0, None, None, None, None), (None, None, None, None, None, None)
    have = items(spark, ("A1", "M", *fine), ("B1", "M", *bare), ("C1", "M", *fine), ("D1", "M", *fine), ("E1", "M", *fine))
    none = spark.createDataFrame([], "item_id string, code string")
    schema = "product_url string, image_url string, image_count int, group_id string, group_name string, families array<string>, issue string"
    url = "https://x/{}.jpg".format
    feed = [("u1", url(1), 1, "g", "G", ["A1"], None), ("u2", url(2), 1, "g", "G", ["B1"], None), ("u3", url(3), 2, "g", "G", ["C1", "A1"], None), ("u4", url(4), 1, "g", "G", ["D1"], None), ("u5", url(5), 1, "g", "G", ["E1"], None)]
    feed += [("u6", url(6), 1, "g", "G", ["ZZ"], None), ("u7", url(7), 1, None, "H", ["A1"], None), ("u8", " ", 1, "g", "G", ["A1"], None), ("u9", url(9), 1, "g", "G", [], None), ("u10", url(10), 1, "g", "G", ["A1"], "missing_serial")]
    parts = lambda *ids: spark.createDataFrame([(i,) for i in ids], "item_id string")
    done = spark.createDataFrame([("i4", None)], "id string, hash string")
    got = jobs.image_candidates(have, none, spark.createDataFrame(feed, schema), imaged=parts("i3"), done=done)
    assert [(r.item_id, r.product_url) for r in got["candidates"].collect()] == [("i2", "u3")]
    assert got["funnel"].first().asDict() == {
        "records_total": 10, "records_valid": 9, "records_invalid": 2, "records_with_main_image": 8, "records_without_main_image": 1, "records_rejected_placeholder_image": 0,
        "families_available": 5, "families_ambiguous": 1, "families_without_group": 1, "families_without_items": 1, "matched_items": 4, "priceable_items": 3,
        "skipped_not_in_media_report": 0, "skipped_checkpointed": 1, "skipped_not_failed_checkpoint": 0, "skipped_not_priceable": 1, "skipped_existing_image": 1,
        "copy_sources_available": 1, "candidates_available": 1, "candidates_selected": 1,
    }
    listed = jobs.image_candidates(have, none, spark.createDataFrame(feed, schema), allowed=parts("i3"), replace_existing=True, cross_group=True, limit=1)
    assert [r.item_id for r in listed["candidates"].collect()] == ["i3"]
    assert listed["funnel"].first().skipped_not_in_media_report == 3


def test_unit_repair(spark):
    have = items(spark, ("S1", "M", 0.52, 2.157, None, None, None, None), ("S1", "M", 0.52, 2157.0, None, None, None, None), ("S2", "M", 1.0, 3.0, None, None, None, None))
    got = {r.row_no: r for r in enrich.repaired_units(have, F.col("pt_ppm") < 100).collect()}
    assert got[0].pt_ppm == 2157.0 and got[0].assay_fingerprint is None and got[2].assay_fingerprint is not None


def test_dedupe(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "k string, n int")
    assert sorted((r.k, r.n) for r in dedupe.first_per_key(df, ["k"], ["n"]).collect()) == [("a", 1), ("b", 3)]
    hits = match.tiered(spark.createDataFrame([(1, "u", "h"), (2, None, "h"), (3, "x", "y")], "k int, u string, h string"), spark.createDataFrame([("A", "u", "z"), ("B", None, "h"), ("C", None, "h")], "id string, u string, h string"), "k", [("u", "u"), ("h", "h")], "id")
    assert {r.k: (r.n, r.id) for r in hits.collect()} == {1: (1, "A"), 2: (2, None), 3: (0, None)}


def test_sources(spark, tmp_path):
    (tmp_path / "feed.json").write_text(json.dumps([{"product_url": "u1", "serial_code": "s", "image_urls": ["a"]}, {"product_url": "u2"}]))
    got = io.feed(spark, str(tmp_path / "feed.json"))
    assert got.count() == 2
    io.as_lines(got, str(tmp_path / "lines"))
    assert io.feed(spark, str(tmp_path / "lines"), lines=True).count() == 2
    (tmp_path / "bad.json").write_text('{"product_url": 1')
    with pytest.raises(Exception):
        io.feed(spark, str(tmp_path / "bad.json")).collect()
    m = io.mapping(spark.createDataFrame([(1, '{"A b": "x", "12": "y", "c": " "}'), (2, '{"a-b": "z"}')], "n int, body string"), "body", ["n"])
    assert [tuple(r) for r in m.collect()] == [("a-b", "z")]
    for name in ("b10.xlsx", "b2.XLS", "~$b3.xlsx", "c.csv"):
        (tmp_path / "w" / "7").mkdir(parents=True, exist_ok=True)
        (tmp_path / "w" / "7" / name).write_text("x")
    assert [r.path.rsplit("/")[-1] for r in io.workbooks(spark, str(tmp_path / "w")).collect()] == ["b2.XLS", "b10.xlsx"]
    (tmp_path / "r.csv").write_text("media_id,model_id\n1,\nx,\n2,\n2,\n")
    report = io.read_report(spark, str(tmp_path / "r.csv"))
    assert sorted(r.media_id for r in io.report_media(report).collect()) == [1, 2]
    media = spark.createDataFrame([(1, "i1"), (3, "i3")], "media_id long, item_id string")
    assert [r.item_id for r in io.report_items(report, media).collect()] == ["i1"]
    io.write_audit(str(tmp_path / "audit"), one=spark.createDataFrame([(["b", "a"],)], "x array<string>"))
    assert [tuple(r) for r in io.read_report(spark, str(tmp_path / "audit" / "one")).collect()] == [("a|b",)]
    io.write_summary(media, str(tmp_path / "summary"))
    assert spark.read.json(str(tmp_path / "summary")).count() == 2
    long = cells(spark, "s", [{1: "a", 26: "z"}, {2: "b"}])
    long.write.parquet(str(tmp_path / "cells"))
    assert io.cells(spark, str(tmp_path / "cells"), 1, 1).count() == 1


def test_streams(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    bodies = [("Pt", 100.0), ("Pd", 50.0), ("Rh", 10.0)]
    rows = [(m, "usd", t0 + timedelta(hours=h), json.dumps({"data": [{"bid": p + h}]})) for h in range(3) for m, p in bodies if (h, m) != (2, "Rh")]
    for k in range(0, len(rows), 3):
        spark.createDataFrame(rows[k : k + 3] + rows[:1], stream.BODY).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    raw = spark.readStream.schema(stream.BODY).json(str(tmp_path / "in"))
    once = stream.without_repeats(stream.parsed(raw))
    q = once.writeStream.format("memory").queryName("once").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == len(rows)
    best = stream.complete(spark.table("once")).collect()
    assert [(r.currency, r.pt_oz, r.rh_oz) for r in best] == [("USD", 101.0, 11.0)]
    sink = stream.latest_sink(str(tmp_path / "latest"))
    q = stream.snapshots(stream.parsed(raw), "1 minute").writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.pt_oz for r in stream.latest(spark, str(tmp_path / "latest")).collect()] == [101.0]


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def test_stream_fallback_equals_batch(spark, tmp_path):
    from assayer.operators.price import last_known

    t0 = datetime(2024, 1, 1)
    good = {10: 5.0, 75: 7.0, 210: 6.0, 400: 8.0, 402: 9.0}
    files = [  # seconds in the order of arrival; each file is a batch
        [50, 10, 0],
        [75, 60, 45, 75],  # two polls at one time, one of them failed
        [200, 140, 136, 210],
        [155, 205],  # late, within the delay
        [402, 401, 400],
        [30, 100],  # behind the watermark: dropped
        [2000],  # closes all before it
        [3000],
    ]
    kind = "currency string, at timestamp, value double"
    rows = []
    for n, batch in enumerate(files):
        part = []
        for s in batch:
            value = None if s in [int((r[1] - t0).total_seconds()) for r in part] else good.get(s)
            part += [(c, t0 + timedelta(seconds=s), None if value is None else value * k) for c, k in (("USD", 1), ("EUR", 2))]
        spark.createDataFrame(part, kind).coalesce(1).write.json(str(tmp_path / f"in{n}"))
        rows += part if n != 5 else []
    before = {k: spark.conf.get(k) for k in (PROVIDER, "spark.sql.shuffle.partitions")}
    spark.conf.set(PROVIDER, ROCKS)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    (tmp_path / "in").mkdir()
    served = []
    try:
        for n in range(len(files)):  # the query is stopped and taken up again after each file
            for f in (tmp_path / f"in{n}").glob("*.json"):
                f.rename(tmp_path / "in" / f"{n}.json")
            live = stream.with_fallback(spark.readStream.schema(kind).json(str(tmp_path / "in")), 60, "100 seconds")
            q = live.writeStream.foreachBatch(lambda b, _: served.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    df = spark.createDataFrame(rows, kind)
    key = lambda r: (r.currency, r["at"], r.state, r.shown or 0.0)
    batch = last_known(df.withColumn("good", F.col("value").isNotNull()), "at", "value", "currency", 60, tie="good").collect()
    closed = t0 + timedelta(seconds=2900)
    assert sorted(map(key, served)) == sorted(key(r) for r in batch if r["at"] <= closed)
    states = {r.state for r in served}
    assert states == {"fresh", "stale", "unavailable"}
    usd = {int((r["at"] - t0).total_seconds()): r.shown for r in served if r.currency == "USD" and r.state == "stale"}
    assert usd[45] == 5.0 and usd[401] == 8.0  # 45 came after 75 and after its good quote, 401 after 402
