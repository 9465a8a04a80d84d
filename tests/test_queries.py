"""Every catalog query against its SQL in DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from assayer.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "-"
    return f"{v:.6g}" if isinstance(v, float) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    got = [r.asDict() for r in df.collect()]
    if name not in SQL:
        assert got
        return
    out = duck.execute(SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    expected = sorted(tuple(plain(dict(zip(names, r))[c]) for c in order) for r in out.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in got) == expected
