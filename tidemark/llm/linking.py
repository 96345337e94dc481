"""From shared buckets to connected groups without pairing everything in a bucket.

A bucket of up to SMALL members pairs them all, a few pairs a row. In a larger one members first meet their
bucket's centre; what that proves equal becomes one group, and only members of different groups can still add
anything. After a few more centres those are dealt to cells of two blocks of bounded size, and a task compares a cell's members by
their sketches: no pair leaves it that can't be a link. No link that a bucket shows is left unchecked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import dropped, written

SMALL, CHUNK, CHUNK_BYTES, BLOCK_WEIGHT, TURNS = 8, 1 << 19, 4 << 20, 1 << 20, 1
PAIR = "a long, b long"
Fits = Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], np.ndarray]


def shared(buckets: DataFrame) -> DataFrame:
    """Rows (key, node, ...) of the buckets that hold several nodes, with c, how many rows the bucket has."""
    several = buckets.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("c")).where("low < high").select("key", "c")
    return buckets.join(several, "key")


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows that are sorted by ``keys``, many at a time, with the group's number of each row."""
    held: list[pa.RecordBatch] = []
    size = weight = 0

    def cut(final: bool):
        nonlocal held, size, weight
        table = pa.Table.from_batches(held).combine_chunks()
        new = np.ones(table.num_rows, bool)
        new[1:] = np.logical_or.reduce([(c := table.column(k).to_numpy())[1:] != c[:-1] for k in keys])
        end = table.num_rows if final else int(np.flatnonzero(new)[-1])
        held, size, weight = table.slice(end).to_batches(), table.num_rows - end, 0
        return table.slice(0, end), np.cumsum(new[:end]) - 1

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size, weight = size + batch.num_rows, weight + batch.nbytes
        if size > CHUNK // 8 or weight > CHUNK_BYTES:
            out = cut(False)
            if out[0].num_rows:
                yield out
    if size:
        yield cut(True)


def pairs_in(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places within each group of a sorted array of group numbers, in pieces."""
    n = len(group)
    last = np.searchsorted(group, group, side="right")
    more = last - np.arange(n) - 1
    ends = np.cumsum(more)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, side="right")))
        left = np.repeat(np.arange(at, to), more[at:to])
        right = left + 1 + np.arange(len(left)) - np.repeat(ends[at:to] - more[at:to] - (ends[at - 1] if at else 0), more[at:to])
        yield left, right
        at = to


def within(rows: DataFrame, keys: list[str], names: list[str], fits: Fits) -> DataFrame:
    """(a, b) for the pairs of nodes in a group of bounded size that fit; with blocks or components, across those alone."""
    extra = [x for x in ("component", "block", "i", "j") if x in rows.columns]

    def compare(batches):
        for table, group in groups_of(batches, keys):
            x = {c: table.column(c).to_numpy() for c in ["node", *names, *extra]}
            for a, b in pairs_in(group):
                keep = x["node"][a] != x["node"][b]
                if "component" in x:
                    keep &= x["component"][a] != x["component"][b]
                if "block" in x:
                    keep &= (x["i"][a] == x["j"][a]) | (x["block"][a] != x["block"][b])
                a, b = a[keep], b[keep]
                keep = fits(x, a, b)
                p, q = x["node"][a[keep]], x["node"][b[keep]]
                if len(p):
                    found = np.unique(np.stack([np.minimum(p, q), np.maximum(p, q)], axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["a", "b"])

    return rows.select(*dict.fromkeys([*keys, "node", *names, *extra])).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, PAIR)


def mixed_rows(buckets: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Rows with the component of each node, of the buckets that show more than one."""
    if groups is None:
        return buckets.withColumn("component", F.col("node"))
    named = buckets.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    return named.join(several, "key")


def celled(rows: DataFrame, block: int, weight: str) -> DataFrame:
    """Each row once for every cell (key, i, j) of blocks that its own block meets in its bucket.

    A block has about ``block`` members, and fewer if they weigh more than BLOCK_WEIGHT together.
    """
    counts = rows.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / block, F.sum(weight) / BLOCK_WEIGHT)).cast("int").alias("blocks"))
    rows = rows.join(counts, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")


def centred(rows: DataFrame, names: list[str], fits: str, turn: int = 0) -> DataFrame:
    """Pairs of each bucket's centre with its members of other components, as far as they fit.

    The centre is the node that stands for most ``times``: what copies were made of links to more than they do to
    each other. After the first turn it is one of the bucket's second largest component, another each turn.
    """
    s = rows.select("key", "node", "times", F.struct(*names).alias("s"), *(["component"] if turn else [F.col("node").alias("component")]))
    order = F.struct("times", F.xxhash64(F.lit(turn), "node").alias("h"), "node", "s", "component")
    if turn:
        parts = s.groupBy("key", "component").agg(F.count("*").alias("n"), F.max(order).alias("c"))
        rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), F.desc("component")))
        centre = parts.withColumn("rank", rank).where("rank <= 2").where("rank = 2")  # a task sends two a key
    else:
        centre = s.groupBy("key").agg(F.max(order).alias("c"))
    centre = centre.select("key", F.col("c.node").alias("centre"), F.col("c.s").alias("t"), F.col("c.component").alias("there"))
    pairs = s.join(centre, "key").where("component <> there").where(fits)
    return pairs.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))


def linked(first: DataFrame, large: DataFrame, names: list[str], fits: str, verify: Callable[[DataFrame], DataFrame], across: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """(node, component) of the nodes that have a link, or None if none has.

    ``first`` are pairs (a, b) to verify; ``large`` (key, node, times, ...) are the rows of the buckets whose
    members met their centre alone. After TURNS further centres each ``across`` takes those rows whose bucket still
    shows several components, and returns all links (a, b) between them.
    """
    links, groups = None, None
    for turn in range(TURNS + 2):
        rows = None
        if turn:
            rows = written(mixed_rows(large, groups), "mixed")
            if rows.isEmpty():
                dropped(rows)
                break
        pairs = first if not turn else centred(rows, names, fits, turn).distinct() if turn <= TURNS else None
        more = written(verify(pairs) if pairs is not None else across(rows), "links")
        if rows is not None:
            dropped(rows)
        if more.isEmpty():
            dropped(more)
            continue
        every = more if links is None else written(links.union(more), "links")
        for x in (links, groups, more if links is not None else None):
            if x is not None:
                dropped(x)
        links, groups = every, written(components(every), "groups")
    if links is not None:
        dropped(links)
    return groups
