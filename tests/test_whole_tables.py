"""Queries over whole tables: no id range, no modulo and no group is left out."""

import random
import re

import pytest

from assayer.operators import match
from assayer.plans import queries as catalog
from assayer.plans.proxies import Tables


def test_repair_takes_every_row(spark, sf_dir):
    """All rows without a source are looked up; row numbers repeat in the tables, so each number counts once."""
    counts = catalog.QUERIES["j4_repair_items"](spark, sf_dir).first()
    found = {r.kind: r.n for r in catalog.QUERIES["c6_repair_candidates"](spark, sf_dir).selectExpr("least(n, 2) AS kind").groupBy("kind").count().withColumnRenamed("count", "n").collect()}
    assert sum(found.values()) == Tables(spark, sf_dir).items.filter("source IS NULL").select("row_no").distinct().count()
    assert (counts.not_found, counts.ambiguous) == (found[0], found[2])


def test_every_source_and_target_takes_part(spark, sf_dir):
    t = Tables(spark, sf_dir)
    codes = {}
    plain = lambda x: re.sub(r"[\s\-./]+", "", (x or "").upper())
    for r in t.items.select("item_id", "serial_code").collect() + t.codes.select("item_id", "code").collect():
        codes.setdefault(r[0], set()).add(plain(r[1]))
    sources, first = set(), {}
    for r in t.media.filter("flag = 'R'").orderBy("media_id").collect():
        sources.add(r.item_id)
        for c in codes[r.item_id] - {""}:
            first.setdefault(c, r.media_id)
    expected = {i: min(first[c] for c in cs if c in first) for i, cs in codes.items() if i not in sources and any(c in first for c in cs)}
    assert {r.item_id: r.media_id for r in catalog.QUERIES["c18_c19_propagate"](spark, sf_dir).collect()} == expected


def test_positions_cover_all_groups(spark, sf_dir):
    got = sorted(r.position for r in catalog.QUERIES["e13_h33_newest_notes"](spark, sf_dir).collect())
    assert len(got) > 1000 and got == list(range(len(got)))


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_candidates_brute_force(spark, seed):
    r = random.Random(seed)
    pick = lambda *x: r.choice([None, *x])
    make = lambda n, base: [(base + k, pick("g", "h"), pick("M", "m", "N"), pick(1.0, 2.0), pick("s", "t"), pick("d", "e")) for k in range(n)]
    schema = "row_no long, group_id string, model string, weight_kg double, shape_code string, details string"
    rows, items = make(60, 0) + make(20, 0), make(40, 1000)  # row numbers below 20 stand twice
    got = {x.row_no: (x.n, x.item_no) for x in match.repair_candidates(spark.createDataFrame(rows, schema), spark.createDataFrame(items, schema), ["weight_kg", "shape_code"]).collect()}
    for no in range(60):
        tiers = {0: set(), 1: set()}
        for _, g, m, w, s, d in (x for x in rows if x[0] == no):
            for i in items:
                if g is not None and g == i[1] and (m or "").upper() == (i[2] or "").upper() and w in (None, i[3]) and s in (None, i[4]):
                    tiers[0 if d in (None, i[5]) else 1].add(i[0])
        best = tiers[0] or tiers[1]
        assert got[no] == (len(best), min(best) if len(best) == 1 else None)
