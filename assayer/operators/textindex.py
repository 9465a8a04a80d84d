"""Many contains-searches at once over an index of distinct texts.

A text holds a search if one of its windows of the search's length is that search.  So a thousand searches are one equi-join of windows and
searches, whose rows are the matches and not searches times texts.  Only places at which some search begins have windows, and only of
the lengths of the searches that begin so.  Items are met once, by those of their texts that were found.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.shared import saved

#: Letters by which places are chosen, and how many such beginnings are sent to all tasks at most; more are joined by sorting.
HEAD, HEADS = 3, 100_000
#: Letters of a window at most; a longer search goes by its first ones and is compared with the texts found there.
WINDOW = 32
#: So many of the most frequent texts are left out of the owners beforehand if no search finds them.
FREQUENT = 1000


class TextIndex(NamedTuple):
    """``owners`` (normal, text, item_id), lazy, and ``texts`` (normal, text, n), distinct; normal: it is searched in its normal form too."""

    owners: DataFrame
    texts: DataFrame


def text_index(items: DataFrame, codes: DataFrame) -> TextIndex:
    """The index of serials, models and extra codes; models are searched as written only."""
    of = lambda df, normal, text: df.select(F.lit(normal).alias("normal"), F.col(text).alias("text"), "item_id").filter("text <> ''")
    owners = of(items, True, "serial_code").unionByName(of(items, False, "model")).unionByName(of(codes, True, "code"))
    return TextIndex(owners, saved(owners.groupBy("normal", "text").agg(F.count("*").alias("n"))))


def _form(kind: str, text: str) -> Column:
    """The text in the form of a kind; p: lower case, n: normal form."""
    return F.when(F.col(kind) == "p", F.lower(text)).otherwise(C.normalize_serial(text))


def _asked(searches: DataFrame) -> DataFrame:
    """(search_id, kind, asked): both forms of every search that finds anything."""
    forms = searches.select("search_id", F.lower(C.trim("text")).alias("p"), C.normalize_serial("text").alias("n")).filter("n <> '' AND p <> ''")
    return forms.select("search_id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("asked")) for k in ("p", "n")))).alias("s")).select("search_id", "s.*")


def _windows(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(kind, window, normal, text): what stands in the texts at places where a search begins, in the lengths of such searches."""
    ends = asked.select("kind", F.left("asked", F.lit(HEAD)).alias("head"), F.least(F.length("asked"), F.lit(WINDOW)).alias("size"))
    heads = ends.groupBy("kind", "head").agg(F.collect_set("size").alias("sizes"))
    counts = heads.groupBy(F.length("head").alias("letters")).count().collect()  # a row for each number of letters up to HEAD
    heads = F.broadcast(heads) if sum(r["count"] for r in counts) <= HEADS else heads.hint("merge")
    letters = F.array(*(F.lit(n) for n in sorted(r["letters"] for r in counts) or [1]))
    kinds = F.when(F.col("normal"), F.array(F.lit("p"), F.lit("n"))).otherwise(F.array(F.lit("p")))
    forms = texts.select("normal", "text", F.explode(kinds).alias("kind")).withColumn("_form", _form("kind", "text")).filter("_form <> ''")
    places = forms.withColumn("_at", F.explode(F.sequence(F.lit(1), F.length("_form")))).withColumn("_letters", F.explode(letters))
    begun = places.withColumn("head", F.substring("_form", F.col("_at"), F.col("_letters"))).join(heads, ["kind", "head"]).withColumn("_size", F.explode("sizes"))
    return begun.filter("_at + _size - 1 <= length(_form)").select("kind", F.substring("_form", F.col("_at"), F.col("_size")).alias("window"), "normal", "text")


def found_texts(index: TextIndex, searches: DataFrame) -> DataFrame:
    """(search_id, normal, text): the texts that hold a search, distinct."""
    asked = _asked(searches)
    keyed = asked.withColumn("window", F.left("asked", F.lit(WINDOW)))
    # both sides grow with the input, so none is sent through the driver
    hits = _windows(index.texts, asked).join(keyed.hint("merge"), ["kind", "window"])
    return hits.filter((F.length("asked") <= WINDOW) | F.contains(_form("kind", "text"), F.col("asked"))).select("search_id", "normal", "text").distinct()


def searched(index: TextIndex, searches: DataFrame) -> DataFrame:
    """(search_id, item_id) for ``searches`` (search_id, text), each as ``search.text_search`` finds them.

    A search is trimmed and taken literally, without regard to case; one without a letter in its normal form finds nothing.
    """
    found, key = saved(found_texts(index, searches)), ["normal", "text"]
    frequent = saved(index.texts.orderBy(F.desc("n"), *key).limit(FREQUENT).select(*key))
    hit = found.join(F.broadcast(frequent), key, "left_semi").select(*key).distinct()
    owners = index.owners.join(F.broadcast(frequent.join(hit, key, "left_anti")), key, "left_anti")
    return owners.join(found.hint("merge"), key).select("search_id", "item_id").distinct()
