"""Chat formatting: collapse logged snapshots of one growing conversation, then render what is left.

A service that logs the whole history at every turn stores each conversation many times, each record a
prefix of the next. A rolling hash over the turns names every prefix, so "this record is the start of a
longer one" is an equi anti-join on (length, hash) and no two conversations are ever compared directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The public ChatML turn markers.
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"


def turns(conversations: DataFrame) -> DataFrame:
    """Turns in order with a rolling hash of all turns so far.

    Rows without conv_id belong to no conversation and go. A null role or text is an empty one. Rows that
    repeat wholly count once; turns of equal number follow in order of role and text, a null number comes
    first. Other columns are left behind, whatever their names.
    """
    by_conv = Window.partitionBy("conv_id")
    order = by_conv.orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    same = F.lag(F.struct("turn", "role", "text")).over(order).eqNullSafe(F.struct("turn", "role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = rows.withColumn("repeated", same).where("NOT repeated").drop("repeated")
    rows = rows.withColumn("k", F.row_number().over(order)).withColumn("n", F.count("*").over(by_conv))
    so_far = by_conv.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for name, seed in (("prefix_a", 1), ("prefix_b", 2)):
        rows = rows.withColumn(name, F.bit_xor(F.xxhash64(F.lit(seed), "k", "role", "text")).over(so_far))
    return rows


def maximal(rows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies) of conversations that start no longer one; of equal ones the smallest conv_id."""
    whole = rows.where("k = n").groupBy("n", "prefix_a", "prefix_b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    shorter = rows.where("k < n").select(F.col("k").cast("long").alias("n"), "prefix_a", "prefix_b").distinct()
    return whole.join(shorter, ["n", "prefix_a", "prefix_b"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "copies")


def formatted(conversations: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, copies, rendered.

    Turn markers that occur inside a role or text are broken up with a space, so that only real turns have them.
    """
    rows = turns(conversations)
    safe = lambda c: F.replace(F.col(c), F.lit("<|"), F.lit("< |"))
    turn = F.concat(F.lit(TURN_START), safe("role"), F.lit("\n"), safe("text"), F.lit(TURN_END + "\n"))
    said = rows.select("conv_id", "k", turn.alias("said")).join(maximal(rows), "conv_id")
    return said.groupBy("conv_id", "n_turns", "copies").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "said"))), lambda x: x["said"]), "").alias("rendered")
    )


ORACLE = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM t),
c AS (SELECT conv_id, count(*) AS n, list(role || chr(0) || text ORDER BY k) AS l,
             string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY k) AS rendered
      FROM k GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, n AS n_turns, count(*) AS copies, l, min(rendered) AS rendered FROM c GROUP BY n, l),
p AS (SELECT DISTINCT l[1:i] AS l FROM (SELECT l, unnest(range(1, n)) AS i FROM c WHERE n > 1))
SELECT conv_id, n_turns, copies, rendered FROM u WHERE l NOT IN (SELECT l FROM p)
"""
