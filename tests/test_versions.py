"""Tables in versions: bucketed upserts, retries, dead writers, dry runs, and the stream's latest table."""

import random
from datetime import datetime

import pytest

from assayer.sources import versions
from assayer.streaming import quotes as stream

SCHEMA = "id long, value string, extra double"


def table(spark, path):
    return {r.id: (r.value, r.extra) for r in versions.read(spark, path).collect()}


def files(spark, path):
    return versions.Versions(spark, path).current()["files"]


def test_upserts_equal_a_dict(spark, tmp_path):
    path, r, expected = str(tmp_path / "t"), random.Random(1), {}
    for step in range(4):
        rows = [(k, r.choice([None, "a", "b"]), r.choice([None, 1.0, 2.0])) for k in r.sample(range(200), 60)]
        inserted = sum(k not in expected for k, *_ in rows)
        updated = sum(k in expected and any(v is not None and v != o for v, o in zip(x, expected[k])) for k, *x in rows)
        dry = versions.upsert(spark, path, spark.createDataFrame(rows, SCHEMA), "id", buckets=16, dry=True)
        assert (versions.Versions(spark, path).current() or {"version": 0})["version"] == step
        wet = versions.upsert(spark, path, spark.createDataFrame(rows, SCHEMA), "id", buckets=16)
        assert wet == dry and (wet["inserted"], wet["updated"], wet["unchanged"]) == (inserted, updated, 60 - inserted - updated)
        for k, *x in rows:
            expected[k] = tuple(v if v is not None else o for v, o in zip(x, expected.get(k, (None, None))))
        assert table(spark, path) == expected


def test_untouched_files_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.upsert(spark, path, spark.range(500).selectExpr("id", "'x' AS value", "1.0D AS extra"), "id", buckets=32)
    before = files(spark, path)
    got = versions.upsert(spark, path, spark.createDataFrame([(7, "new", None)], SCHEMA), "id")
    after = files(spark, path)
    assert len(before) == 32 and got == {"inserted": 0, "updated": 1, "unchanged": 0, "buckets": 1}
    assert sum(before[b] != after[b] for b in before) == 1
    assert table(spark, path)[7] == ("new", 1.0) and len(table(spark, path)) == 500
    versions.Versions(spark, path).vacuum(keep=1)
    assert len(table(spark, path)) == 500 and len(list((tmp_path / "t" / "versions").glob("v*"))) == 1


def test_a_retry_writes_once(spark, tmp_path):
    path, more = str(tmp_path / "t"), spark.createDataFrame([(1, "a", 1.0), (2, "b", None)], SCHEMA)
    assert versions.upsert(spark, path, more, "id", token="t1")["inserted"] == 2
    assert versions.upsert(spark, path, more, "id", token="t1") == {}
    assert versions.Versions(spark, path).current()["version"] == 1


def test_a_writer_that_dies_leaves_nothing(spark, tmp_path, monkeypatch):
    path, more = str(tmp_path / "t"), spark.createDataFrame([(1, "a", 1.0)], SCHEMA)
    versions.upsert(spark, path, more, "id", token="t1")
    with monkeypatch.context() as m:
        m.setattr(versions.Versions, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            versions.upsert(spark, path, spark.createDataFrame([(1, "z", None), (2, "b", None)], SCHEMA), "id", token="t2")
    assert table(spark, path) == {1: ("a", 1.0)}
    assert versions.upsert(spark, path, spark.createDataFrame([(1, "z", None), (2, "b", None)], SCHEMA), "id", token="t2")["inserted"] == 1
    assert table(spark, path) == {1: ("z", 1.0), 2: ("b", None)}
    versions.Versions(spark, path).vacuum(keep=1)
    assert table(spark, path) == {1: ("z", 1.0), 2: ("b", None)}


def test_two_writers(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.upsert(spark, path, spark.createDataFrame([(1, "a", 1.0)], SCHEMA), "id")
    one = versions.Versions(spark, path)
    now = one.current()
    one.commit({k: now[k] for k in ("files", "buckets", "schema")}, now, "x")
    with pytest.raises(versions.Conflict):
        one.commit({k: now[k] for k in ("files", "buckets", "schema")}, now, "y")


def test_repeated_keys_and_no_changes(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(Exception, match="twice"):
        versions.upsert(spark, path, spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0)], SCHEMA), "id")
    assert versions.upsert(spark, path, spark.createDataFrame([], SCHEMA), "id") == {"inserted": 0, "updated": 0, "unchanged": 0, "buckets": 0}
    with pytest.raises(ValueError):
        versions.read(spark, path)


def test_latest_table_of_a_stream(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "latest")
    batch = lambda *rows: spark.createDataFrame(list(rows), "currency string, at timestamp, pt_oz double")
    day = lambda n: datetime(2024, 1, n)
    sink = stream.latest_sink(path)
    sink(batch(("USD", day(2), 5.0), ("EUR", day(1), 4.0)), 0)
    sink(batch(("USD", day(3), 6.0)), 1)
    sink(batch(("USD", day(9), 99.0)), 1)  # the same batch again
    with monkeypatch.context() as m:
        m.setattr(versions.Versions, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            sink(batch(("USD", day(4), 7.0)), 2)
    assert {(r.currency, r.pt_oz) for r in stream.latest(spark, path).collect()} == {("USD", 6.0), ("EUR", 4.0)}
    for k in range(2, 6):
        sink(batch(("USD", day(2 + k), float(k))), k)
    assert {(r.currency, r.pt_oz) for r in stream.latest(spark, path).collect()} == {("USD", 5.0), ("EUR", 4.0)}
    assert len(list((tmp_path / "latest" / "versions").glob("v*"))) == 2
    assert len(list((tmp_path / "latest" / "data").glob("*/*.parquet"))) <= 4
