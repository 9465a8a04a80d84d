"""Prices, estimates and market series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.quality import priceable

METALS = ("pt", "pd", "rh")


def latest(df: DataFrame, at: str, *columns: str) -> DataFrame:
    """One row: the columns of the latest row (E2); ties go to the greatest row."""
    best = df.agg(F.max(F.struct(at, *columns)).alias("r"))
    return best.select("r.*")


def latest_per_key(df: DataFrame, key: str, at: str, *columns: str) -> DataFrame:
    return df.groupBy(key).agg(F.max(F.struct(at, *columns)).alias("r")).select(key, "r.*")


def spot_pivot(spot: DataFrame, key: str = "key", value: str = "price_oz") -> DataFrame:
    """The metals' prices as one row pt, pd, rh."""
    return spot.agg(*(F.max(F.when(F.col(key) == m, F.col(value))).alias(f"{m}_oz") for m in METALS))


def unit_price(oz, gram=None) -> Column:
    """Price of a gram: from the ounce, else the given gram price, else nothing."""
    prices = [F.when(C._c(oz) > 0, C._c(oz) / C.OUNCE_PRICED)]
    if gram is not None:
        prices.append(F.when(C._c(gram) > 0, C._c(gram)))
    return F.coalesce(*prices, F.lit(0.0))


def item_price(weight, pt, pd, rh, pt_oz, pd_oz, rh_oz, rate) -> Column:
    """weight / 1000 * sum of ppm * gram price * rate, at least 0, in cents; 0 when not priceable."""
    total = F.lit(0.0)
    for ppm, oz in ((pt, pt_oz), (pd, pd_oz), (rh, rh_oz)):
        total = total + F.coalesce(C._c(ppm), F.lit(0.0)) * unit_price(oz)
    value = F.round(F.greatest(C._c(weight) / 1000 * total * rate, F.lit(0.0)), 2)
    return F.when(priceable(weight, pt, pd, rh), value).otherwise(F.lit(0.0))


def priced(items: DataFrame, spot: DataFrame, rate: float | Column = 0.8, name: str = "price") -> DataFrame:
    """Items with a price from a one-row table of ounce prices (C21); 0 for all if that is empty."""
    row = spot.limit(1)
    r = rate if isinstance(rate, Column) else F.lit(rate)
    # the spot table has one row, whatever the data
    joined = items.join(F.broadcast(row), F.lit(True), "left")
    return joined.withColumn(name, item_price("weight_kg", "pt_ppm", "pd_ppm", "rh_ppm", "pt_oz", "pd_oz", "rh_oz", r)).drop("pt_oz", "pd_oz", "rh_oz")


def rate_setting(settings: DataFrame, key: str, default: float = 80.0) -> DataFrame:
    """One row: the stored rate or the default, as a ratio."""
    return settings.filter(F.col("key") == key).agg(C.clamped_rate(F.coalesce(F.max("value").try_cast("double"), F.lit(default))).alias("rate"))


def what_if(items: DataFrame, spot: DataFrame, now: float, then: float) -> DataFrame:
    """Prices at two rates, their difference and the change in percent (P5)."""
    both = priced(priced(items, spot, now, "current"), spot, then, "preview")
    diff = F.round(F.col("preview") - F.col("current"), 2)
    return both.withColumn("difference", diff).withColumn("change_pct", F.when(F.col("current") > 0, F.round(diff / F.col("current") * 100, 2)).otherwise(F.lit(0.0)))


def estimate(df: DataFrame, fx_rate: float = 1.0) -> DataFrame:
    """Values of a lot by metal and in all, from weight, unit, ppm, gram prices, rates and humidity."""
    w = F.greatest(F.col("weight"), F.lit(0.0))
    grams = F.when(F.lower(F.trim("weight_unit")) == "kg", w * 1000).otherwise(w)
    wet = F.least(F.greatest(C.ratio("humidity_rate"), F.lit(0.0)), F.lit(1.0))
    total, out = F.lit(0.0), df
    for m in METALS:
        held = F.greatest(F.col(f"{m}_ppm"), F.lit(0.0)) / 1000000 * grams
        value = held * F.greatest(F.coalesce(f"{m}_usd_per_gram", F.lit(0.0)), F.lit(0.0)) * C.recovery_rate(f"{m}_rate") * (1 - wet)
        out = out.withColumn(f"{m}_grams", F.round(held, 6)).withColumn(f"{m}_value_usd", F.round(value, 2)).withColumn(f"{m}_value_eur", F.round(value * fx_rate, 2))
        total = total + value
    return out.withColumn("weight_in_grams", F.round(grams, 2)).withColumn("total_usd", F.round(total, 2)).withColumn("total_eur", F.round(total * fx_rate, 2))


def bucket(df: DataFrame, at: str) -> Column:
    """Days of a time, or runs of 65,536 of a number: a key's rows are handled bucket by bucket, as one key may hold most rows."""
    return F.to_date(at) if dict(df.dtypes)[at].startswith(("timestamp", "date")) else F.floor(F.col(at) / (1 << 16))


def change_series(df: DataFrame, key: str, at: str, value: str, given: str | None = None) -> DataFrame:
    """``change_pct``: the given change, else the change from the previous row; 0 at first and after 0.

    The row before the first of a bucket is the last of the bucket before, from a table of one row a bucket.
    """
    rows = df.withColumn("_b", bucket(df, at))
    ends = rows.groupBy(key, "_b").agg(F.max_by(F.struct(value), at).alias("_end"))
    ends = ends.withColumn("_end", F.lag("_end").over(Window.partitionBy(key).orderBy("_b")))
    rows = rows.join(ends, [key, "_b"])
    own = Window.partitionBy(key, "_b").orderBy(at)
    before = F.coalesce(F.lag(F.struct(value)).over(own), F.col("_end"))[value]
    change = F.when(before != 0, F.round((F.col(value) - before) / before * 100, 4)).otherwise(F.lit(0.0))
    change = F.when(before.isNull(), F.lit(0.0)).otherwise(change)
    return rows.withColumn("change_pct", F.coalesce(F.col(given), change) if given else change).drop("_b", "_end")


def daily(df: DataFrame, at: str, value: str, days: int, key: str) -> DataFrame:
    """One row for each key and each of the last days, with the day's last value or none."""
    days = min(max(days, 1), 14)
    last = df.groupBy(key, F.to_date(at).alias("day")).agg(F.max_by(value, at).alias(value))
    ends = df.agg(F.to_date(F.max(at)).alias("_end"))
    # one row with the last date, crossed with the few distinct keys
    spine = df.select(key).distinct().crossJoin(F.broadcast(ends)).select(key, F.explode(F.sequence(F.date_sub("_end", days - 1), "_end")).alias("day"))
    return spine.join(last, [key, "day"], "left")


def converted(df: DataFrame, rates: DataFrame, value: str, currency: str) -> DataFrame:
    """Values in another currency; a rate that is missing counts as 1."""
    return df.join(rates.select(F.col("currency").alias(currency), "rate"), currency, "left").withColumn("converted", F.round(F.col(value) * F.coalesce("rate", F.lit(1.0)), 2)).drop("rate")


def complete_snapshots(quotes: DataFrame, snapshot: str, key: str = "key", price: str = "price_oz") -> DataFrame:
    """Snapshots in which all three metals have a positive price."""
    good = F.count_distinct(F.when((F.col(price) > 0) & F.col(key).isin(*METALS), F.col(key)))
    return quotes.groupBy(snapshot).agg((good == len(METALS)).alias("complete"))


def last_known(snapshots: DataFrame, at: str, value: str, key: str, ttl_seconds: int = 86_400, tie: str | None = None) -> DataFrame:
    """Failed snapshots (null value) take the last good one, if it is young enough (S2, batch form).

    The last good one of earlier buckets comes from a table of one row a bucket.
    """
    order = [at, *([tie] if tie else [])]
    rows = snapshots.withColumn("_b", bucket(snapshots, at)).withColumn("_good", F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("at"), F.col(value).alias("v"))))
    ends = rows.groupBy(key, "_b").agg(F.max_by("_good", F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_end"))
    earlier = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_end", F.last("_end", ignorenulls=True).over(earlier))
    w = Window.partitionBy(key, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(ends, [key, "_b"])
    kept = F.coalesce(F.last("_good", ignorenulls=True).over(w), F.col("_end"))
    age = F.unix_timestamp(at) - F.unix_timestamp(kept["at"])
    state = F.when(F.col(value).isNotNull(), "fresh").when(kept.isNotNull() & (age <= ttl_seconds), "stale").otherwise("unavailable")
    return rows.withColumn("state", state).withColumn("shown", F.when(F.col("state") != "unavailable", kept["v"])).drop("_b", "_good", "_end")


def market_days(quotes: DataFrame, at: str, value: str, key: str, days: int = 14, currency: str = "USD", rate: float | Column = 1.0) -> DataFrame:
    """One row for each of the last days: the metals' prices, carried on over days without a quote, their
    change from the day before (0 at first), and for another currency the converted prices and the rate (P7)."""
    each = daily(quotes.filter(F.col(key).isin(*METALS)), at, value, days, key)
    wide = each.groupBy("day").agg(*(F.max(F.when(F.col(key) == m, F.col(value))).alias(f"{m}_usd") for m in METALS))
    w = Window.orderBy("day")  # 14 rows at most
    for m in METALS:
        wide = wide.withColumn(f"{m}_usd", F.last(f"{m}_usd", ignorenulls=True).over(w))
        before = F.lag(f"{m}_usd").over(w)
        wide = wide.withColumn(f"{m}_change", F.when(before != 0, F.round((F.col(f"{m}_usd") - before) / before * 100, 2)).otherwise(F.lit(0.0)))
    if currency.strip().upper() == "USD":
        return wide
    fx = rate if isinstance(rate, Column) else F.lit(rate)
    return wide.withColumns({f"{m}_shown": F.round(F.col(f"{m}_usd") * fx, 2) for m in METALS} | {"currency": F.lit(currency.strip().upper()), "fx_rate": F.round(fx, 6)})
