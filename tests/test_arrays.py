"""JSON arrays cut at byte ranges, against a whole parse."""

import json
import random

import pytest
from pyspark.sql import types as T

from assayer.sources import arrays, io

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("t", T.StringType()), T.StructField("more", T.ArrayType(T.StructType([T.StructField("x", T.StringType())])))])


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "96")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def records(n, seed):
    r = random.Random(seed)
    text = lambda: "".join(r.choice(["a", "}", "{", "[", "]", '"', "\\", ",", " ", "\n", "é", "漢", "x" * 70]) for _ in range(r.randrange(0, 12)))
    return [{"id": k, "t": r.choice([None, text()]), "more": r.choice([None, [], [{"x": text()} for _ in range(r.randrange(4))]])} for k in range(n)]


@pytest.mark.parametrize("seed,indent", [(1, None), (2, 1), (3, None)])
def test_equals_a_whole_parse(spark, tmp_path, small_blocks, seed, indent):
    some = records(120, seed)
    (tmp_path / "a.json").write_text(json.dumps(some, indent=indent, ensure_ascii=seed == 1))
    (tmp_path / "b.json").write_text(" [ ] \n")
    (tmp_path / "c.json").write_text(json.dumps([{"id": -1}]))
    read = arrays.array_records(spark, str(tmp_path), SCHEMA)
    assert arrays._pieces(spark, str(tmp_path)).rdd.getNumPartitions() > 20
    got = sorted(read.collect(), key=lambda x: x.id)
    assert [x.asDict(recursive=True) for x in got] == [{"id": -1, "t": None, "more": None}, *some]
    one_task = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(str(tmp_path))
    assert sorted(map(str, one_task.collect())) == sorted(map(str, got))


@pytest.mark.parametrize("text", ['{"id": 1}', '[{"id": 1}', '[{"id": 1}, ', "", '[{"id": 1}, {"id": 2', '[{"id": 1}]]', '[{"id": 1}] [{"id": 2}]', '[{"id": "a}]'])
def test_no_array(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception):
        arrays.array_records(spark, str(tmp_path), SCHEMA).collect()


@pytest.mark.parametrize("text", ['[{"id": 1} {"id": 2}]', '[{"id": 1},, {"id": 2}]', '[{"id": 1}, 5, {"id": 2}]', '[{"id": "one"}]', '[{"id": 1,}]', '[{"id": 1}, ]', '[, {"id": 1}]', '[{"id": 1}, 5]', "[7]"])
def test_malformed_records(spark, tmp_path, small_blocks, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception):
        arrays.array_records(spark, str(tmp_path), SCHEMA).collect()


def test_written_arrays_come_back(spark, tmp_path):
    df = spark.range(0, 500, 1, 5).selectExpr("id", "concat('t}', id, '\"') AS t")
    arrays.write_arrays(df.filter("id < 400"), str(tmp_path / "f"))  # the last partition is empty
    assert sorted(map(tuple, arrays.array_records(spark, str(tmp_path / "f"), df.schema).collect())) == sorted(map(tuple, df.filter("id < 400").collect()))


def test_feed_reads_arrays(spark, tmp_path):
    (tmp_path / "feed.json").write_text(json.dumps([{"product_url": "u", "card_texts": ["a", "}"]}]))
    r = io.feed(spark, str(tmp_path / "feed.json")).first()
    assert (r.product_url, r.card_texts, r.brand) == ("u", ["a", "}"], None)


def test_filters_of_readers(spark, tmp_path):
    """A filter on what is read may be moved before the choice of pieces; it must not meet the last bracket."""
    (tmp_path / "a.json").write_text("[" + ",\n".join(json.dumps({"id": k, "t": "x"}) for k in range(50)) + "\n]\n")
    read = arrays.array_records(spark, str(tmp_path), SCHEMA)
    assert read.filter("id IS NOT NULL AND coalesce(t, '') = 'x'").select("t").count() == 50
    assert read.filter("id IS NULL").count() == 0
