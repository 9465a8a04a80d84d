"""Tables in versions: data files are written aside first, then one manifest names the files of the new version.

A manifest is written under a name of its own and renamed to its version's number, which fails if that number
is taken.  So readers see whole versions only, a writer that dies before the rename leaves nothing that is read, and
of two writers one fails.  A manifest keeps the tokens of the latest changes; a change whose token is
there is not applied again.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Tokens that a manifest keeps: a change may be tried again until so many others were applied.
TOKENS = 200


class Conflict(Exception):
    """Another writer has made the version."""


class Versions:
    """The versions of the table in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(self._conf)

    def _names(self) -> list[str]:
        folder = self._path(f"{self.path}/versions")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(folder) if f.getPath().getName().startswith("v")) if self._fs.exists(folder) else []

    def current(self) -> dict | None:
        """The manifest of the latest version."""
        names = self._names()
        return json.loads(self.spark.read.text(f"{self.path}/versions/{names[-1]}", wholetext=True).first()[0]) if names else None

    def applied(self, token: str) -> bool:
        return token in ((self.current() or {}).get("tokens", []))

    def commit(self, manifest: dict, before: dict | None, token: str) -> dict:
        """Makes ``manifest`` the version after ``before``."""
        number = (before or {"version": 0})["version"] + 1
        whole = {**manifest, "version": number, "tokens": [*(before or {}).get("tokens", []), token][-TOKENS:]}
        staged, final = self._path(f"{self.path}/versions/.{uuid.uuid4().hex}"), self._path(f"{self.path}/versions/v{number:012d}.json")
        out = self._fs.create(staged, False)
        out.write(json.dumps(whole).encode())
        out.close()
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.getFileSystem(self._conf).getUri(), self._conf)
        plain = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._fs.makeQualified(staged), self._fs.makeQualified(final), plain)
        except Exception as e:
            self._fs.delete(staged, False)
            if self._fs.exists(final):
                raise Conflict(f"version {number} is there already") from e
            raise
        return whole

    def files(self, folder: str) -> list[str]:
        """Data files below a folder, relative to the table's."""
        found, each = [], self._fs.listFiles(self._path(f"{self.path}/{folder}"), True)
        base = self._fs.makeQualified(self._path(self.path)).toString() + "/"
        while each.hasNext():
            name = each.next().getPath()
            if name.getName().endswith(".parquet"):
                found.append(name.toString().removeprefix(base))
        return sorted(found)

    def vacuum(self, keep: int = 2) -> None:
        """Deletes older versions, and data files that none of the latest ``keep`` names."""
        names = self._names()
        kept = set()
        for n in names[-keep:]:
            kept |= set(sum(json.loads(self.spark.read.text(f"{self.path}/versions/{n}", wholetext=True).first()[0])["files"].values(), []))
        for name in self.files("data") if self._fs.exists(self._path(f"{self.path}/data")) else []:
            if name not in kept:
                self._fs.delete(self._path(f"{self.path}/{name}"), False)
        for n in names[:-keep]:
            self._fs.delete(self._path(f"{self.path}/versions/{n}"), False)


def counted(df: DataFrame, counters: dict[str, Column], sink=None) -> dict:
    """Counters over the rows, taken in the pass that hands them to ``sink``, or in one without a sink (A10)."""
    seen = Observation(f"counted-{uuid.uuid4().hex}")
    out = df.observe(seen, *(c.alias(n) for n, c in counters.items()))
    if sink is None:
        out.write.format("noop").mode("overwrite").save()
    else:
        sink(out)
    try:
        return seen.get
    except Py4JJavaError:  # a table that the optimizer knows to be empty loses its observation
        return df.agg(*(c.alias(n) for n, c in counters.items())).first().asDict()


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the latest version."""
    now = Versions(spark, path).current()
    if now is None:
        raise ValueError(f"no version of a table in {path}")
    files = [f"{path.rstrip('/')}/{f}" for some in now["files"].values() for f in some]
    empty = spark.createDataFrame([], now["schema"])
    return spark.read.schema(empty.schema).parquet(*files) if files else empty


def upsert(spark: SparkSession, path: str, changes: DataFrame, key: str, token: str | None = None, buckets: int = 64, dry: bool = False) -> dict:
    """Matched rows take the changes that are not null, unmatched ones are added (A9); counters inserted, updated, unchanged, buckets.

    Rows lie in ``buckets`` by a hash of the key, fixed with the first version.  Only buckets with a change are read and written;
    the files of the others stay in the next version as they are.  A key that ``changes`` has twice is an error.  A token that was
    applied before changes nothing and gives no counters.  With ``dry`` all is counted and nothing is written (A10).
    """
    table, token = Versions(spark, path), token or uuid.uuid4().hex
    now = table.current()
    if now and token in now["tokens"]:
        return {}
    buckets = now["buckets"] if now else buckets
    schema = spark.createDataFrame([], now["schema"]).schema if now else changes.schema
    at = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    placed = changes.withColumn("_bucket", at)
    touched = sorted(r[0] for r in placed.select("_bucket").distinct().collect())  # no more than buckets
    held = [f"{table.path}/{f}" for b in touched for f in (now or {"files": {}})["files"].get(str(b), [])]
    old = spark.read.schema(schema).parquet(*held) if held else spark.createDataFrame([], schema)
    own = [c for c in schema.names if c != key]
    changed = [c for c in own if c in changes.columns]
    twice = F.count("*").over(Window.partitionBy(key)) > 1
    new = changes.withColumn("_new", F.when(twice, F.raise_error(F.lit(f"a key stands twice in the changes of {key}")).cast("boolean")).otherwise(True))
    new = new.select(key, "_new", *(F.col(c).alias(f"_{c}") for c in changed))
    both = old.withColumn("_old", F.lit(True)).join(new, key, "full")
    differs = F.lit(False)
    for c in changed:
        differs = differs | (F.col(f"_{c}").isNotNull() & ~F.col(f"_{c}").eqNullSafe(F.col(c)))
    merged = both.select("_old", "_new", differs.alias("_differs"), key, *(F.coalesce(f"_{c}", c).cast(schema[c].dataType).alias(c) if c in changed else F.col(c) for c in own))
    here, came = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    counters = {"inserted": F.count_if(~here & came), "updated": F.count_if(here & came & F.col("_differs")), "unchanged": F.count_if(here & came & ~F.col("_differs"))}
    folder = f"data/{uuid.uuid4().hex}"
    write = lambda df: df.withColumn("_bucket", at).repartition("_bucket").select("_bucket", *schema.names).write.partitionBy("_bucket").parquet(f"{table.path}/{folder}")
    out = counted(merged, counters, None if dry else write) | {"buckets": len(touched)}
    if not dry and touched:
        files = dict((now or {"files": {}})["files"])
        written = table.files(folder)
        for b in touched:
            files[str(b)] = [f for f in written if f"/_bucket={b}/" in f]
        table.commit({"files": files, "buckets": buckets, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)}, now, token)
    return out
