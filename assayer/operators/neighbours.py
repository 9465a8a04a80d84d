"""The nearest items of a group by a value, for every item."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rank import parts, ranked

#: Items that a task compares at a time, besides k from the blocks on either side.
BLOCK = 4096


def similar_items(items: DataFrame, k: int, value: str = "pt_ppm", group: str = "group_id", item: str = "item_id") -> DataFrame:
    """(item, other, rank): the k others of the item's group with the nearest values, k from 1 to 20.

    Items stand in the order of group, value and id; of equally near values the nearer place in that order wins, then the lower
    one.  So the k nearest are among k places on either side.  Places are found over ranges of the whole order, and cut into
    blocks of ``BLOCK`` with k places of the blocks beside them, so that a large group is dealt over tasks and none sees it whole.
    Items without a group or a value have no others.
    """
    k = min(max(k, 1), 20)
    some = items.filter(F.col(group).isNotNull() & F.col(value).isNotNull()).select(F.col(group).alias("_group"), F.col(value).alias("_value"), F.col(item).alias("_item"))
    placed = ranked(some, [("_group", False), ("_value", False), ("_item", False)], "_place")
    own, inside = F.floor(F.col("_place") / BLOCK), F.col("_place") % BLOCK
    blocks = F.array_compact(F.array(own, F.when((inside < k) & (own > 0), own - 1), F.when(inside >= BLOCK - k, own + 1)))
    # as many tasks as ranges, since a task sorts what it is dealt; few rows are left to Spark
    n = parts(placed.agg(F.max("_place")).first()[0] or 0)
    dealt = placed.withColumn("_own", own).withColumn("_block", F.explode(blocks))
    dealt = dealt.repartition(n, "_block") if n > 1 else dealt
    around = Window.partitionBy("_block").orderBy("_place").rowsBetween(-k, k)
    near = dealt.withColumn("_near", F.collect_list(F.struct("_group", "_place", "_value", "_item")).over(around)).filter("_block = _own")
    far = lambda x: F.struct(F.abs(x["_value"] - F.col("_value")).alias("value"), F.abs(x["_place"] - F.col("_place")).alias("places"), x["_place"].alias("place"), x["_item"].alias("item"))
    others = F.filter("_near", lambda x: (x["_group"] == F.col("_group")) & (x["_place"] != F.col("_place")))
    best = F.slice(F.array_sort(F.transform(others, far)), 1, k)
    return near.select(F.col("_item").alias(item), F.posexplode(best).alias("_n", "_o")).select(item, F.col("_o.item").alias("other"), (F.col("_n") + 1).cast("long").alias("rank"))
