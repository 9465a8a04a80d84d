"""Indexed searches and nearest items against scans; dry runs of the jobs against runs with a sink."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from assayer.operators import neighbours, report, search, textindex
from assayer.plans import jobs
from assayer.plans import queries as catalog
from assayer.plans.proxies import Tables


def test_searches_equal_the_scan(spark):
    r = random.Random(2)
    text = lambda n: r.choice([None, "", "".join(r.choice("aB1-. /é") for _ in range(r.randrange(0, n)))])
    items = spark.createDataFrame([(f"i{k}", text(9), text(7)) for k in range(150)], "item_id string, serial_code string, model string")
    codes = spark.createDataFrame([(f"i{r.randrange(160)}", text(8)) for _ in range(200)], "item_id string, code string")
    asked = ["", " ", "-./", "a", "A", " b1", "1-", "ab", "a.b", "é", "zzz", "%", *("".join(r.choice("aB1- ") for _ in range(r.randrange(1, 6))) for _ in range(25))]
    got = defaultdict(set)
    for x in textindex.searched(textindex.text_index(items, codes), spark.createDataFrame(list(enumerate(asked)), "search_id long, text string")).collect():
        got[x.search_id].add(x.item_id)
    known = {x.item_id for x in items.collect()}
    for k, t in enumerate(asked):
        assert got[k] & known == {x.item_id for x in search.text_search(items, codes, t).collect()}, t


def test_a_thousand_searches_read_few_rows(spark):
    items = spark.range(3000).selectExpr("concat('i', id) AS item_id", "concat('KT-', id * 7919 % 100000) AS serial_code", "'M' AS model")
    codes = items.select("item_id", F.lit("x").alias("code")).limit(0)
    index = textindex.text_index(items, codes)
    asked = spark.range(1000).selectExpr("id AS search_id", "concat('t-', id * 7919 % 100000) AS text")
    out = textindex.searched(index, asked)
    assert out.select("search_id").distinct().count() == 1000
    assert out.filter("search_id = 5").count() == search.text_search(items, codes, f"t-{5 * 7919 % 100000}").count()


@pytest.mark.parametrize("k,block", [(3, 7), (20, 64), (1, 4096)])
def test_similar_items_equal_all_pairs(spark, monkeypatch, k, block):
    monkeypatch.setattr(neighbours, "BLOCK", max(block, k))
    r = random.Random(k)
    rows = [(f"i{n:03d}", r.choice(["g", "g", "g", "h", None]), r.choice([None, 1.0, 1.0, 2.0, float(r.randrange(100))])) for n in range(260)]
    got = defaultdict(list)
    for x in sorted(neighbours.similar_items(spark.createDataFrame(rows, "item_id string, group_id string, pt_ppm double").repartition(5), k).collect(), key=lambda x: x["rank"]):
        got[x.item_id].append(x.other)
    for g in "gh":
        own = sorted((v, i) for i, h, v in rows if h == g and v is not None)
        for p, (v, i) in enumerate(own):
            others = sorted((abs(w - v), abs(q - p), q, j) for q, (w, j) in enumerate(own) if q != p)
            assert got.pop(i, []) == [x[3] for x in others[:k]]
    assert not got


def test_dry_runs_count_as_runs_do(spark, sf_dir, tmp_path):
    t = Tables(spark, sf_dir)
    no, a = t.items.filter("source IS NULL"), t.items.filter("source = 'A'")
    groups = t.groups.withColumn("sheet_name", F.concat(F.lit("SHEET "), F.substring("id", 2, 9)))
    fixed = no.drop("group_id").withColumnsRenamed({"row_no": "row"}).withColumns({"manufacturer": F.lit("france"), "file": F.col("model")})
    feed, known = catalog._feed(t), catalog._feed_items(t)
    enriched = jobs.enrich_items(a, no.withColumn("file", F.col("model")), ["row_no"])
    made = {
        "import_cells": (jobs.import_cells(catalog._cells(t), catalog._known_cells(t), groups), "rows"), "import_fixed": (jobs.import_fixed(fixed, a, t.groups), "rows"), "enrich_items": (enriched, "outcomes"),
        "repair_items": (jobs.repair_items(a, no, ["weight_kg", "pt_ppm", "shape_code"]), "outcomes"), "import_feed": (jobs.import_feed(feed, known, t.groups.select(F.col("id").alias("slug"))), "outcomes"),
        "repair_from_feed": ({"outcomes": jobs.repair_from_feed(feed, known), "report": None}, "outcomes"),
    }
    for name, (job, rows) in made.items():
        dry = jobs.settled(name, job[rows])
        path = str(tmp_path / name)
        wet = jobs.settled(name, job[rows], lambda df: df.write.parquet(path))
        assert dry == wet and sum(dry.values()) > 0 and spark.read.parquet(path).count() == job[rows].count()
        if name == "enrich_items":
            total = job["totals"].first()
            assert all(dry[o] == total[n] for n, o in report.ENRICHMENT.items())
        elif job["report"] is not None:
            by = job["report"].agg(*(F.sum(o).alias(o) for o in dry)).first().asDict()
            assert dry == by
