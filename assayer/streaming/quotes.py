"""Quote streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import columns as C
from ..operators.price import METALS
from ..sources.versions import Versions, read

BODY = "metal string, currency string, fetched_at timestamp, body string"


def parsed(raw: DataFrame) -> DataFrame:
    """Quotes of raw bodies: key, currency, fetched_at, price_oz, change_pct."""
    return raw.select(F.lower("metal").alias("key"), F.upper("currency").alias("currency"), "fetched_at", C.quote_bid("body").alias("price_oz"), C.quote_change_pct("body").alias("change_pct"))


def without_repeats(quotes: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each quote once, however often it is delivered within the watermark."""
    return quotes.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["key", "currency", "fetched_at"])


def complete(quotes: DataFrame) -> DataFrame:
    """Latest snapshot (currency, fetched_at) with all metals, as one row a currency: batch form."""
    one = quotes.filter((F.col("price_oz") > 0) & F.col("key").isin(*METALS))
    snaps = one.groupBy("currency", "fetched_at").agg(*(F.max(F.when(F.col("key") == m, F.col("price_oz"))).alias(f"{m}_oz") for m in METALS))
    full = snaps.filter(" AND ".join(f"{m}_oz IS NOT NULL" for m in METALS))
    best = full.groupBy("currency").agg(F.max(F.struct("fetched_at", *(f"{m}_oz" for m in METALS))).alias("r"))
    return best.select("currency", "r.*")


def snapshots(quotes: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The complete snapshots of a stream, each once its minute is closed by the watermark."""
    good = quotes.withWatermark("fetched_at", delay).filter((F.col("price_oz") > 0) & F.col("key").isin(*METALS))
    w = F.window("fetched_at", "1 minute")
    each = good.groupBy("currency", w).agg(*(F.max_by(F.when(F.col("key") == m, F.col("price_oz")), F.when(F.col("key") == m, F.col("fetched_at"))).alias(f"{m}_oz") for m in METALS))
    return each.filter(" AND ".join(f"{m}_oz IS NOT NULL" for m in METALS)).select("currency", F.col("window.start").alias("at"), *(f"{m}_oz" for m in METALS))


def latest_sink(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: keeps the latest snapshot of each currency as a table in versions.

    Data are written aside, then a manifest names them: a reader sees one whole version at any time.  A batch that is tried again, by
    its query and number, changes nothing.  The version before stays for readers that began with it; older ones are removed.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        token = f"{spark.sparkContext.getLocalProperty('sql.streaming.queryId')}:{number}"
        table = Versions(spark, path)
        now = table.current()
        if now and token in now["tokens"]:
            return
        both = batch.unionByName(read(spark, path)) if now else batch
        rest = [c for c in batch.columns if c not in ("currency", "at")]
        best = both.groupBy("currency").agg(F.max(F.struct("at", *rest)).alias("r")).select("currency", "r.*")
        folder = f"data/{uuid.uuid4().hex}"
        best.write.parquet(f"{table.path}/{folder}")
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in best.schema)
        table.commit({"files": {"all": table.files(folder)}, "schema": kinds}, now, token)
        table.vacuum()

    return write


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``latest_sink`` keeps."""
    return read(spark, path)


class _LastKnown(StatefulProcessor):
    """Polls of one currency wait until the watermark has passed them and are then served in order of time."""

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, value double")
        self.good = handle.getValueState("good", "at long, value double")

    def _wake(self, at_ms: int | None) -> None:
        """The one timer of the currency, at this time."""
        for old in list(self.handle.listTimers()):
            if old != at_ms:
                self.handle.deleteTimer(old)
        if at_ms is not None:
            self.handle.registerTimer(at_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            at = batch["at"].astype("datetime64[us]").astype("int64")
            self.waiting.appendList([(int(a), None if pd.isna(v) else float(v)) for a, v in zip(at, batch["value"])])
            first = min([int(at.min()), *([first] if first is not None else [])])
        due = _ceil_ms(first)
        timers = list(self.handle.listTimers())
        # a timer for forgetting gives way too: it is set again when nothing waits
        if not timers or due < min(timers) or self._idle_until() in timers:
            self._wake(due)
        yield pd.DataFrame(columns=SERVED)

    def _idle_until(self) -> int | None:
        """When the last good quote is too old for any poll to come."""
        return _ceil_ms(self.good.get()[0] + (self.ttl + 1) * 1_000_000) if self.good.exists() else None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs() * 1000
        polls = [(r[0], r[1]) for r in self.waiting.get()]
        # of polls at one time, failed ones come first, whatever order they arrived in
        ready = sorted((r for r in polls if r[0] <= closed), key=lambda r: (r[0], r[1] is not None, r[1] or 0.0))
        rest = [r for r in polls if r[0] > closed]
        last = tuple(self.good.get()) if self.good.exists() else None
        out = []
        for at, value in ready:
            t = pd.Timestamp(at, unit="us")
            if value is not None:
                last = (at, value)
                out.append((key[0], t, "fresh", value))
            elif last and at // 1_000_000 - last[0] // 1_000_000 <= self.ttl:
                out.append((key[0], t, "stale", last[1]))
            else:
                out.append((key[0], t, "unavailable", None))
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        if last and last[0] + (self.ttl + 1) * 1_000_000 > closed:
            self.good.update(last)
        else:
            self.good.clear()
        self._wake(_ceil_ms(min(r[0] for r in rest)) if rest else self._idle_until())
        yield pd.DataFrame(out, columns=SERVED)

    def close(self) -> None:
        pass


def _ceil_ms(us: int) -> int:
    return -(-us // 1000)


SERVED = ["currency", "at", "state", "shown"]


def with_fallback(quotes: DataFrame, ttl_seconds: int = 86_400, delay: str = "1 minute") -> DataFrame:
    """Stream form of the last-known rule: one row for each poll (currency, at, value), failed ones (null value) served from state.

    A poll is served once the watermark, the latest time seen less ``delay``, has passed it, and then in the order of time: polls
    that come out of order within the delay give what the batch form gives.  Later ones are dropped.  Of polls at the same time,
    failed ones come first.  Polls without a time are dropped.  A currency keeps what waits, and its last good quote until that is too old.
    The state is held by RocksDB: ``spark.sql.streaming.stateStore.providerClass`` must name Spark's ``RocksDBStateStoreProvider``.
    """
    polls = quotes.select("currency", "at", F.col("value").cast("double").alias("value")).filter("at IS NOT NULL").withWatermark("at", delay)
    kinds = "currency string, at timestamp, state string, shown double"
    return polls.groupBy("currency").transformWithStateInPandas(_LastKnown(ttl_seconds), kinds, "append", "eventTime")
