"""Which side of a join may be sent through the driver: never one that grows with the input."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from assayer.operators import hamming, match  # noqa: E402
from assayer.plans import queries  # noqa: E402
from assayer.sources import arrays  # noqa: E402


def sent(df) -> list[str]:
    """The broadcast joins of the plan, as first made from the sizes of files."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]


@pytest.mark.parametrize("name", ["a3_b14_e8_e9_h27_j1_cells", "h12_j3_enrichment_rows", "j1_import_cells"])
def test_cells_are_not_sent(spark, sf_dir, name):
    joins = sent(queries.QUERIES[name](spark, sf_dir))
    assert joins and not [j for j in joins if "BuildLeft" in j]
    assert not [j for j in joins if "_sig" in j]


def test_looked_up_hashes_are_not_sent(spark):
    known = spark.range(50).withColumnRenamed("id", "_reference")
    found = hamming.candidates(spark.range(50).withColumnRenamed("id", "phash"), hamming.index(known, 8), 8, [0, 1])
    assert not sent(found)
    assert found.filter("phash = _reference").select("phash").distinct().count() == 50


def test_no_frame_of_the_feed_scan_ends_unbounded(spark, tmp_path):
    arrays.write_arrays(spark.range(5), str(tmp_path / "a"))
    texts = arrays.array_texts(spark, str(tmp_path / "a"))
    assert "unboundedfollowing" not in texts._jdf.queryExecution().optimizedPlan().toString().lower()
    assert sorted(r.value for r in texts.collect()) == [f'{{"id":{k}}}' for k in range(5)]


def test_sides_of_tiers_are_not_sent(spark):
    left, right = spark.range(3).selectExpr("id AS k", "id AS a"), spark.range(3).selectExpr("id AS t", "id AS b")
    tiers = match.tiered(left, right, "k", [("a", "b")], "t")
    assert not [j for j in sent(tiers) if "_k" in j]


@pytest.mark.parametrize("group", ["group_id", None])
def test_family_counts_equal_the_join(spark, group):
    items = spark.createDataFrame([("a", "g", "k1"), ("b", "g", "k-2"), ("c", "h", "K1"), ("d", "h", None)], "item_id string, group_id string, serial_code string")
    codes = spark.createDataFrame([("a", "k2"), ("a", "k 1"), ("d", "k2"), ("c", "")], "item_id string, code string")
    wanted = spark.createDataFrame([("one", "g", "K1"), ("two", "g", "K1"), ("two", "g", "K2"), ("two", "g", "K2"), ("none", "h", "K9"), ("other", "h", "K2")], "wanted_id string, group_id string, serial string")
    wanted = wanted if group else wanted.drop("group_id")
    want = match.family_join(items, codes, wanted, group).groupBy("wanted_id").count()
    assert sorted(match.family_counts(items, codes, wanted, group).collect()) == sorted(want.collect())
