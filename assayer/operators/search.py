"""Search, listing and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.quality import priceable

SORTS = ("created_at", "serial_code", "model")


def visible(items: DataFrame, media: DataFrame) -> DataFrame:
    """Priceable items with an image (B2)."""
    return items.filter(priceable()).join(media.select("item_id").distinct(), "item_id", "left_semi")


def text_search(items: DataFrame, codes: DataFrame, text: str) -> DataFrame:
    """Serial, model or a code holds the text, or its normal form (if not empty) a normal form of them.

    The text is taken literally, without regard to case.
    """
    low, key = text.strip().lower(), "".join(ch for ch in text.upper() if ch not in " \t\n-./")
    plain = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(low)), F.lit(False)) & F.lit(low != "")
    normal = lambda c: F.contains(C.normalize_serial(c), F.lit(key)) & F.lit(key != "")
    if not key:
        plain = lambda c: F.lit(False)
    hit = codes.filter(plain("code") | normal("code")).select("item_id").distinct().withColumn("_hit", F.lit(True))
    out = items.join(hit, "item_id", "left")
    return out.filter(plain("serial_code") | plain("model") | normal("serial_code") | F.coalesce("_hit", F.lit(False))).drop("_hit")


def group_filter(items: DataFrame, groups: DataFrame, text: str | None) -> DataFrame:
    """By id if the text is a uuid, else by part of a name; no text, no filter."""
    if not text or not text.strip():
        return items
    t = text.strip().lower()
    uuid = len(t) == 36 and [len(p) for p in t.split("-")] == [8, 4, 4, 4, 12]
    cond = F.col("id") == t if uuid else F.contains(F.lower("name"), F.lit(t)) | F.contains(F.lower(F.coalesce("sheet_name", F.lit(""))), F.lit(t))
    return items.join(groups.filter(cond).select(F.col("id").alias("group_id")), "group_id", "left_semi")


def with_image(items: DataFrame, media: DataFrame, wanted: bool | None) -> DataFrame:
    """Items with, without, or with or without an image."""
    if wanted is None:
        return items
    return items.join(media.select("item_id").distinct(), "item_id", "left_semi" if wanted else "left_anti")


def app_users(users: DataFrame, roles: DataFrame, admin: tuple[str, ...] = ("admin", "super_admin")) -> DataFrame:
    """Users with the role app_user or none, and no admin role."""
    flags = roles.groupBy("user_id").agg(F.max((F.col("role") == "app_user").cast("int")).alias("_app"), F.max(F.col("role").isin(*admin).cast("int")).alias("_admin"))
    return users.join(flags, "user_id", "left").filter("(_app IS NULL OR _app = 1) AND coalesce(_admin, 0) = 0").drop("_app", "_admin")


def saved_flag(items: DataFrame, saved: DataFrame, user) -> DataFrame:
    """``is_saved`` for a user."""
    own = saved.filter(F.col("user_id") == user).select("item_id").distinct().withColumn("_s", F.lit(True))
    return items.join(own, "item_id", "left").withColumn("is_saved", F.col("_s").isNotNull()).drop("_s")


def embedded(items: DataFrame, groups: DataFrame, codes: DataFrame) -> DataFrame:
    """Items with their group's name and the sorted list of their codes."""
    lists = codes.groupBy("item_id").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    named = items.join(groups.select(F.col("id").alias("group_id"), F.col("name").alias("group_name")), "group_id", "left")
    return named.join(lists, "item_id", "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))


def sorted_by(df: DataFrame, sort: str = "-created_at", tie: str = "item_id") -> DataFrame:
    """One of the allowed orders, with the id against ties (F2)."""
    name = sort.lstrip("-")
    if name not in SORTS:
        raise ValueError(f"cannot sort by {name}")
    return df.orderBy(F.desc(name) if sort.startswith("-") else F.asc(name), tie)


def page(df: DataFrame, number: int, size: int, order: list) -> DataFrame:
    """A page with total, first and last index, and last page (F1)."""
    total = df.agg(F.count("*").alias("total"))
    start = (max(number, 1) - 1) * size
    rows = df.orderBy(*order).offset(start).limit(size)
    # the total is one row
    out = rows.crossJoin(F.broadcast(total))
    return out.withColumn("first_index", F.lit(start + 1)).withColumn("last_index", F.least(F.lit(start + size), F.col("total")).cast("int")).withColumn("last_page", F.greatest(F.ceil(F.col("total") / size), F.lit(1)).cast("int"))


def similar(items: DataFrame, k: int, value: str = "pt_ppm", tie: str = "item_id") -> DataFrame:
    """The k items with the highest value in each group (F4, batch form; C23 leaves the item itself out)."""
    k = min(max(k, 1), 20)
    w = Window.partitionBy("group_id").orderBy(F.desc_nulls_last(value), tie)
    return items.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def related(items: DataFrame, item, k: int = 6) -> DataFrame:
    """Others of an item's group, newest first."""
    group = items.filter(F.col("item_id") == item).select("group_id").distinct()
    return items.join(F.broadcast(group), "group_id", "left_semi").filter(F.col("item_id") != item).orderBy(F.desc("created_at"), "item_id").limit(k)


def newest_visible(items: DataFrame, media: DataFrame, k: int = 6) -> DataFrame:
    """The newest visible items."""
    return visible(items, media).orderBy(F.desc("created_at"), "item_id").limit(k)


def saved_items(saved: DataFrame, items: DataFrame, user) -> DataFrame:
    """A user's saved items that still exist, newest saved first (F8)."""
    own = saved.filter(F.col("user_id") == user).join(items.select("item_id"), "item_id", "left_semi")
    return own.orderBy(F.desc("day"), "item_id")


def visible_groups(groups: DataFrame, items: DataFrame, media: DataFrame) -> DataFrame:
    """Groups with a visible item, by name."""
    return groups.join(visible(items, media).select(F.col("group_id").alias("id")), "id", "left_semi").orderBy("name")


def suggestions(items: DataFrame, codes: DataFrame, text: str, k: int = 10) -> DataFrame:
    """Codes that hold the text: unique ignoring case, those that begin with it first, in natural order."""
    low = text.strip().lower()
    every = items.select(C.trim("serial_code").alias("code")).unionByName(codes.select(C.trim("code").alias("code"))).filter(F.contains(F.lower("code"), F.lit(low)) & (F.col("code") != ""))
    one = every.groupBy(F.lower("code").alias("_low")).agg(F.min("code").alias("code"))
    return one.orderBy(F.desc(F.startswith("_low", F.lit(low))), C.natural_key("code"), "code").limit(k).select("code")


def file_order(paths: DataFrame, path: str = "path", start: str | None = None) -> DataFrame:
    """Files by folder (numbers first, as numbers) and natural name; with a start the order is rotated."""
    folder = F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    ok = name.rlike(r"(?i)\.xlsx?$") & ~name.startswith("~$")
    number = folder.try_cast("int")
    out = paths.filter(ok).withColumn("_number", number).withColumn("_folder", C.natural_key(folder)).withColumn("_name", C.natural_key(name))
    order = [F.asc_nulls_last("_number"), F.asc("_folder"), F.asc("_name"), F.asc(path)]
    if start is not None:
        order = [F.desc((C.natural_key(name) >= C.natural_key(F.lit(start))).cast("int")), *order]
    return out.orderBy(*order).drop("_number", "_folder", "_name")


def recipients(users: DataFrame, roles: DataFrame, audience: DataFrame | None = None) -> DataFrame:
    """Active app users, all or those of an audience."""
    out = app_users(users, roles).filter("is_active")
    return out.join(audience.select("user_id").distinct(), "user_id", "left_semi") if audience is not None else out
