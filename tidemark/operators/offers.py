"""Recommendations over what each user may be offered: eligible items of a catalogue of any size, scored by each model.

A user never meets the catalogue as rows: they meet it as sorted lists of at most MAX_BLOCK items, take the best they
may be offered from each, and the ranking afterwards compares what the lists gave.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .recommend import admits, histories

#: Items of one list. One list is broadcast; several are joined by their number and a share of the users.
MAX_BLOCK, PARTS = 10_000, 64
RULES = ("active", "repeatable", "plans", "personas", "sizes", "required", "incompatible")


def people(users: DataFrame, found: DataFrame) -> DataFrame:
    """``users`` (user_id, plan, persona, size) with had and done, the items of their history and those of them consumed."""
    return histories(users, found)


def scored(items: DataFrame, scores: DataFrame, source: str, fallback: Column | None = None, fallback_source: str = "") -> DataFrame:
    """The catalogue with score and source: a positive score of the model, else a positive ``fallback``, else a hundredth of the item's priority."""
    own = F.coalesce("score", F.lit(0.0))
    value = F.when(own > 0, own)
    name = F.when(own > 0, F.lit(source))
    if fallback is not None:
        value, name = value.when(fallback > 0, fallback), name.when(fallback > 0, F.lit(fallback_source))
    by = [c for c in scores.columns if c not in ("score", "all")]
    rows = items.join(scores, "item", "left") if "segment" not in items.columns else items.join(scores, by, "left")
    return rows.withColumns({"source": name.otherwise(F.lit("catalogue_fallback")), "score": F.bround(value.otherwise(F.col("priority") * 0.01), 6)})


def shelves(items: DataFrame, blocks: int, by: list[str]) -> DataFrame:
    """(by, block, items): scored items, best first, in ``blocks`` lists by hash of the item."""
    entry = F.struct((-F.col("score")).alias("order"), "item", "source", *RULES)
    rows = items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
    return rows.groupBy(*by, "block").agg(F.array_sort(F.collect_list(entry)).alias("items"))


def offered(users: DataFrame, items: DataFrame, n_items: int, k: int, by: list[str]) -> DataFrame:
    """(user_id, item, score, source): of each list the k best items that a user may be offered and has not in ``taken``."""
    blocks = max(1, -(-n_items // MAX_BLOCK))
    lists = shelves(items, blocks, by)
    if blocks == 1 and not by:
        rows = users.join(F.broadcast(lists))  # one row of MAX_BLOCK items at most
    else:
        part = F.pmod(F.xxhash64("user_id"), F.lit(PARTS)).cast("int")
        asked = users.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("part", part)
        rows = asked.join(lists.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), [*by, "block", "part"])
    open_ = F.filter("items", lambda x: admits(lambda c: x[c]) & ~F.array_contains("taken", x["item"]))
    return rows.select("user_id", F.explode(F.slice(open_, 1, k)).alias("x")).select("user_id", "x.item", (-F.col("x.order")).alias("score"), "x.source")


def _none_taken(users: DataFrame) -> DataFrame:
    return users.withColumn("taken", F.array().cast("array<string>"))


def by_popularity(users: DataFrame, items: DataFrame, scores: DataFrame, k: int, source: str = "global_popularity") -> DataFrame:
    """Items by (item, score) of all users; ``users`` as ``people`` gives them, ``items`` the catalogue with priority."""
    return offered(_none_taken(users), scored(items, scores.select("item", "score"), source), items.count(), k, [])


def by_segment(users: DataFrame, items: DataFrame, segment_scores: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """Items by the score in the user's ``segment``, where it has none by that of all users. The segments are few, a list for each."""
    every = items.join(scores.select("item", F.col("score").alias("all")), "item", "left")
    every = every.crossJoin(users.select("segment").distinct())
    rows = scored(every, segment_scores.select("segment", "item", "score"), "segment_popularity", F.col("all"), "segment_global_fallback")
    return offered(_none_taken(users), rows, items.count(), k, ["segment"])


def by_similarity(users: DataFrame, items: DataFrame, found: DataFrame, pairs: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """What a user's history is similar to, by the largest similarity times weight, with the item that led there in the source; the others by popularity."""
    reach = found.select("user_id", F.col("item").alias("other"), "weight").join(pairs.select("item", "other", "similarity"), "other")
    reach = reach.withColumn("s", F.bround(F.col("similarity") * F.col("weight"), 6)).where("s > 0")
    best = reach.groupBy("user_id", "item").agg(F.max("s").alias("score"), F.min_by("other", F.struct((-F.col("s")).alias("s"), "other")).alias("best"))
    near = best.join(users, "user_id").join(items, "item").where(admits(F.col))
    near = near.select("user_id", "item", "score", F.concat(F.lit("item_similarity:"), "best").alias("source"))
    taken = near.groupBy("user_id").agg(F.collect_set("item").alias("taken"))
    rest = users.join(taken, "user_id", "left").withColumn("taken", F.coalesce("taken", F.array().cast("array<string>")))
    return near.unionByName(offered(rest, scored(items, scores.select("item", "score"), "cf_popularity_fallback"), items.count(), k, []))
