"""Connected components of an edge table: contraction within parts of bounded size, then alternating stars.

A task joins the edges of its part into trees. Edges that fit one part are done then. Of more, what trees are
left meet by large and small stars: every step is a grouping with a join, hubs are pre-aggregated and joined
rather than gathered, and each round is cut with a scratch table. Rounds grow with the logarithm of the longest
chain.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import dropped, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


#: Edges of one part, some hundred bytes each while a task joins them.
PART = 1 << 20


def contracted(edges: DataFrame, parts: int) -> DataFrame:
    """(u, v) from every node to the smallest that its part's edges reach."""

    def join(batches):
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
        out = [(x, y) for x in root if (y := find(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["u", "v"])

    return edges.select("u", "v").coalesce(parts).mapInArrow(join, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of a written edge table (a, b); the component is its smallest node."""
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    parts = max(1, -(-pairs.count() // PART))
    now = written(contracted(pairs, parts), "edges")
    if parts == 1:
        return with_roots(now)
    before = _state(now)
    while before[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        after = written(small, "stars")
        state = _state(after)
        dropped(now)
        now = after
        if state == before:
            break
        before = state
    return with_roots(now)


def with_roots(stars: DataFrame) -> DataFrame:
    leaves = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
