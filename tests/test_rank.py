"""Positions and pages against plain sorting."""

import random

from assayer.operators import rank

ORDER = [("day", True), ("name", False), ("no", False)]


def rows(n, seed=3):
    r = random.Random(seed)
    return [(r.choice([None, 1, 1, 1, 2, 3]), r.choice([None, "a", "b"]), k) for k in range(n)]


def plain(some):
    return sorted(some, key=lambda x: (x[0] is None, -(x[0] or 0), x[1] is not None, x[1] or "", x[2]))


def test_positions_and_pages(spark):
    some = rows(700)
    df = spark.createDataFrame(some, "day int, name string, no long").repartition(7)
    expected = plain(some)
    got = {r.no: r.position for r in rank.ranked(df, ORDER).collect()}
    assert got == {x[2]: k for k, x in enumerate(expected)}
    table = rank.ranges(df, ORDER)
    for number in (1, 2, 13, 14, 15):
        page = rank.page_at(table, number, 53).collect()
        assert [(r.no, r.position) for r in page] == [(x[2], k) for k, x in enumerate(expected)][(number - 1) * 53 : number * 53]
    cursor, seen = None, []
    while True:
        page = rank.page_after(df, ORDER, 97, cursor)
        cursor = rank.cursor_of(page, ORDER)
        if cursor is None:
            break
        seen += [r.no for r in page.collect()]
    assert seen == [x[2] for x in expected]


def test_hot_day_is_dealt_over_ranges(spark):
    df = spark.range(40_000).selectExpr("1 AS day", "'x' AS name", "id AS no")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = rank.ranges(df, ORDER)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert table.before.count() > 2 and table.before.agg({"_n": "max"}).first()[0] < 30_000


def test_empty_table(spark):
    df = spark.createDataFrame([], "day int, name string, no long")
    assert rank.ranked(df, ORDER).count() == 0
    assert rank.page_at(rank.ranges(df, ORDER), 2, 10).count() == 0
    assert rank.cursor_of(rank.page_after(df, ORDER, 10), ORDER) is None
