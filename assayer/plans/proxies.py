"""Catalog tables derived from the given tables by expressions that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A line's place, which several lines share, and a number that no two lines share (tests hold that on all scales).
SLOT = "l_orderkey * 10 + l_linenumber"
ITEM = f"({SLOT}) * 1000000000 + (l_partkey % 100000) * 10000 + (l_suppkey % 100) * 100 + CAST(l_quantity AS BIGINT)"

PROXIES: dict[str, tuple[str, dict[str, str]]] = {
    "items": ("lineitem", {
        "row_no": ITEM,
        "slot": SLOT,
        "item_id": f"concat('i', CAST({ITEM} AS STRING))",
        "group_id": "concat('g', CAST(l_suppkey % 25 AS STRING))",
        "serial_code": "CASE WHEN l_partkey % 23 = 0 THEN 'Kontrolinis 7' WHEN l_partkey % 29 = 0 THEN '?..' WHEN l_partkey % 31 = 0 THEN NULL WHEN l_partkey % 37 = 0 THEN 'n/a' ELSE concat(CASE l_linenumber % 4 WHEN 0 THEN 'kt-' WHEN 1 THEN 'KT ' WHEN 2 THEN ' kt./' ELSE 'KT' END, CAST(l_partkey AS STRING)) END",
        "model": "CASE WHEN l_partkey % 41 = 0 THEN '  ' ELSE concat('Model ', CAST(l_partkey % 7 AS STRING)) END",
        "weight_kg": "CASE WHEN l_linenumber = 7 THEN NULL WHEN l_partkey % 17 = 0 THEN l_quantity * 100 ELSE l_quantity / 10 END",
        "pt_ppm": "CASE WHEN l_linenumber = 6 THEN NULL ELSE (l_partkey % 50) * 12.5E0 END",
        "pd_ppm": "CASE WHEN l_discount < 0.02 THEN NULL ELSE round(l_discount * 1000, 1) END",
        "rh_ppm": "CASE WHEN l_tax = 0 THEN NULL ELSE round(l_tax * 100, 1) END",
        "shape_code": "CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE concat('s', CAST(l_partkey % 5 AS STRING)) END",
        "details": "CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE concat('d', CAST(l_partkey % 3 AS STRING)) END",
        "source": "CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END",
        "created_at": "l_shipdate",
    }),
    "media": ("lineitem", {"media_id": f"({ITEM}) * 3", "item_id": f"concat('i', CAST({ITEM} AS STRING))", "flag": "l_returnflag"}),
    "codes": ("lineitem", {"item_id": f"concat('i', CAST({ITEM} AS STRING))", "code": "concat(CASE WHEN l_linenumber % 2 = 0 THEN 'alt-' ELSE 'ALT ' END, CAST(l_suppkey % 60 AS STRING))", "kind": "l_linestatus"}),
    "groups": ("nation", {"id": "concat('g', CAST(n_nationkey AS STRING))", "name": "n_name", "sheet_name": "concat(' new  ', lower(n_name))", "region": "CAST(n_regionkey AS STRING)"}),
    "users": ("customer", {"user_id": "c_custkey", "is_active": "c_acctbal > 0", "lang": "CASE c_nationkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'ar' ELSE 'hu' END", "preferred_language": "CASE c_nationkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'ar' ELSE 'hu' END", "segment": "c_mktsegment"}),
    "roles": ("customer", {"user_id": "c_custkey", "role": "CASE c_custkey % 5 WHEN 0 THEN 'admin' WHEN 1 THEN 'editor' ELSE 'app_user' END", "k": "c_custkey % 7"}),
    "saved": ("lineitem", {"user_id": "l_partkey", "item_id": f"concat('i', CAST({ITEM} AS STRING))", "day": "CAST(l_shipdate AS DATE)"}),
    "quotes": ("events", {"event_id": "event_id", "at": "ts", "key": "CASE event_type WHEN 'view' THEN 'pt' WHEN 'click' THEN 'pd' WHEN 'purchase' THEN 'rh' ELSE event_type END", "price_oz": "round(value, 2)", "user_id": "user_id", "snap": "CAST(floor(event_id / 7) AS BIGINT)", "props": "props"}),
}

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations", "embeddings"]


class Tables:
    """Given tables and proxies as DataFrames, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        source, columns = PROXIES.get(name, (name, None))
        df = self.spark.read.parquet(f"{self.sf_dir}/{source}.parquet")
        return df.selectExpr(*(f"{e} AS {c}" for c, e in columns.items())) if columns else df


def with_sql(*names: str) -> str:
    """Common table expressions of the proxies."""
    parts = []
    for n in names:
        source, columns = PROXIES[n]
        parts.append(f"{n} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source})")
    return "WITH " + ", ".join(parts)
