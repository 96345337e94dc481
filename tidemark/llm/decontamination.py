"""Benchmark decontamination by suffix arrays over the training text.

Each shard, a slice of a megabyte or two of documents inside a task, gets a suffix array of its words. Every
suffix of every test item is looked up in it by binary search. That yields all places where a window of test
words stands verbatim; and since the best partner of a suffix is one of its neighbours in the common order, it
also yields the longest verbatim match of each test suffix and of each document, however short. A word that no
test item has ends a match and starts none, so suffixes from there stay out. Shards exchange nothing.

The test items travel to the tasks in blocks of bounded size, a bounded number of blocks at once. A larger
benchmark takes several passes over the documents, whose findings are merged by row.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import FOLD, NOT_ALNUM, U, parts, prefix, spans, words
from .rows import keyed
from .scratch import written

#: MAX_BYTES of test texts are broadcast at once.
WINDOW, SHARD_BYTES, BLOCK_BYTES, MAX_BYTES = 10, 1 << 20, 4 << 20, 32 << 20


@dataclass
class Block:
    """Test windows of one block of items."""

    vocabulary: np.ndarray  # sorted hashes of test words; a word's id is its place plus one
    text: np.ndarray  # ids of all items' words, each item followed by 0
    start: np.ndarray  # of each distinct window in text
    depth: np.ndarray  # words of the window
    keys: np.ndarray  # the window's words packed, smallest and largest suffix that starts with it
    upper: np.ndarray
    items: list[np.ndarray]  # items of each window
    names: list[str]
    suffix: np.ndarray  # all places of words in text, in the order of their suffixes
    sorted: np.ndarray  # their keys
    remain: np.ndarray  # words to the end of their item
    owner: np.ndarray  # their item
    lanes: int
    bits: int  # of one word's id in a key


def hashed_words(column: pa.Array, limit: int):
    """(first row, end row, word row, word hash) of slices of a column."""
    for a, b, data, ends in parts(column, limit):
        data = FOLD[data]
        start, end, row = words(data, ends, NOT_ALNUM)
        yield a, b, row, spans(prefix(data), start, end)


def packed(ids: np.ndarray, at: np.ndarray, lanes: int, bits: int) -> np.ndarray:
    """Keys of the suffixes at some places: ``lanes`` 64-bit numbers, first words in the highest bits."""
    per = 64 // bits
    padded = np.concatenate([ids, np.zeros(lanes * per, ids.dtype)])
    out = np.zeros((lanes, len(at)), U)
    for k in range(lanes * per):
        out[k // per] |= padded[at + k].astype(U) << U(bits * (per - 1 - k % per))
    return out


def block(rows: list[tuple[str, str]], window: int = WINDOW) -> Block:
    names = [name for name, _ in rows]
    row = np.zeros(0, np.int64)
    found = np.zeros(0, U)
    for a, _, r, h in hashed_words(pa.array([t for _, t in rows], pa.string()), 1 << 40):
        row, found = r + a, h
    vocabulary = np.unique(found)
    assert len(vocabulary) < (1 << 32) - 1
    place = np.arange(len(row)) + row  # a 0 stands after each item
    text = np.zeros(len(row) + len(rows) + 1, np.int64)
    text[place] = np.searchsorted(vocabulary, found) + 1
    sizes = np.bincount(row, minlength=len(rows)) if len(rows) else np.zeros(0, np.int64)
    starts, depths, owners = [], [], []
    begin = np.cumsum(sizes + 1) - sizes - 1
    for i, n in enumerate(sizes.tolist()):
        depth = min(n, window)
        count = n - depth + 1 if n else 0
        starts += (begin[i] + np.arange(count)).tolist()
        depths += [depth] * count
        owners += [i] * count
    bits = 16 if len(vocabulary) < (1 << 16) - 1 else 32
    lanes = math.ceil(window / (64 // bits))
    distinct: dict[tuple, list] = {}
    for s, d, o in zip(starts, depths, owners, strict=True):
        distinct.setdefault(tuple(text[s : s + d]), [s, d, set()])[2].add(o)
    start = np.array([x[0] for x in distinct.values()], np.int64)
    depth = np.array([x[1] for x in distinct.values()], np.int64)
    keys = packed(text, start, lanes, bits)
    upper = keys.copy()
    per = 64 // bits
    for lane in range(lanes):  # words beyond the window: 0 in the lower key, all ones in the upper
        used = np.clip(depth - lane * per, 0, per)
        low = np.array([(1 << (bits * (per - k))) - 1 for k in range(per + 1)], dtype=object)
        mask = np.array([low[k] for k in used], dtype=U) if len(used) else np.zeros(0, U)
        keys[lane] &= ~mask
        upper[lane] |= mask
    places = np.flatnonzero(text)
    every = packed(text, places, lanes, bits)
    order = np.lexsort(every[::-1])
    ends = np.flatnonzero(text == 0)
    remain = ends[np.searchsorted(ends, places)] - places
    return Block(vocabulary, text, start, depth, keys, upper, [np.array(sorted(x[2])) for x in distinct.values()], names, places[order], every[:, order], remain[order], row[order], lanes, bits)


def common(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """How many words two lists of keys share from their start."""
    out, same = np.zeros(a.shape[1], np.int64), np.ones(a.shape[1], bool)
    for lane in range(a.shape[0]):
        x = a[lane] ^ b[lane]
        for k in range(64 // bits):
            same &= (x >> U(64 - bits * (k + 1))) & U((1 << bits) - 1) == 0
            out += same
    return out


def bound(keys: np.ndarray, asked: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of every asked key among sorted ones, all at once; keys have several lanes."""
    n = keys.shape[1]
    low, high = np.zeros(asked.shape[1], np.int64), np.full(asked.shape[1], n)
    for _ in range(max(1, int(n).bit_length())):
        live = low < high
        mid = np.minimum((low + high) >> 1, max(n - 1, 0))
        less, same = np.zeros(len(low), bool), np.ones(len(low), bool)
        for lane in range(keys.shape[0]):
            at = keys[lane][mid]
            less |= same & (at < asked[lane])
            same &= at == asked[lane]
        if right:
            less |= same
        low, high = np.where(live & less, mid + 1, low), np.where(live & ~less, mid, high)
    return low


@dataclass
class Found:
    """What one block's tests and one shard share."""

    hit: np.ndarray  # of each word of the shard
    pairs: np.ndarray  # (row, item) of the windows found
    longest: np.ndarray  # of each row, in words
    where: np.ndarray  # the first word of the longest, -1 without
    of_item: np.ndarray  # longest match of each item
    at_row: np.ndarray  # its row and word, -1 without
    at_word: np.ndarray


def best(groups: np.ndarray, length: np.ndarray, tie: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest length of each of n groups and its place in the list, the one with the smallest tie; -1 without one."""
    order = np.lexsort((tie, -length, groups))
    first = order[np.flatnonzero(np.r_[True, np.diff(groups[order]) > 0])] if len(order) else order
    out, at = np.zeros(n, np.int64), np.full(n, -1)
    out[groups[first]], at[groups[first]] = length[first], first
    return out, at


def search(tests: Block, row: np.ndarray, found: np.ndarray, n_rows: int) -> Found:
    """All test suffixes of a block against the suffix array of a shard."""
    place = np.arange(len(row)) + row
    ids = np.zeros(len(row) + n_rows + 1, np.int64)
    if len(tests.vocabulary):
        at = np.minimum(np.searchsorted(tests.vocabulary, found), len(tests.vocabulary) - 1)
        ids[place] = np.where(tests.vocabulary[at] == found, at + 1, 0)
    hit = np.zeros(len(ids) + 1, np.int64)
    pairs, n_items = np.zeros((0, 2), np.int64), len(tests.names)
    live = np.flatnonzero(ids)
    none = np.zeros(0, np.int64)
    spots, starts, lengths = [none], [none], [none]  # a place of the shard, one of the tests, and how many words agree
    if len(live) and len(tests.suffix):
        keys = packed(ids, live, tests.lanes, tests.bits)
        order = np.lexsort(keys[::-1])  # the suffix array of this shard
        suffixes, keys = live[order], keys[:, order]
        n, m = len(suffixes), len(tests.suffix)
        put = bound(keys, tests.sorted, False)  # where each test suffix would stand
        for side in (put - 1, put):  # its neighbours, and every shard suffix's
            q = np.flatnonzero((side >= 0) & (side < n))
            spots.append(suffixes[side[q]])
            starts.append(q)
            lengths.append(np.minimum(common(keys[:, side[q]], tests.sorted[:, q], tests.bits), tests.remain[q]))
        before = np.searchsorted(put, np.arange(n), side="right") - 1
        for side in (before, before + 1):
            x = np.flatnonzero((side >= 0) & (side < m))
            spots.append(suffixes[x])
            starts.append(side[x])
            lengths.append(np.minimum(common(keys[:, x], tests.sorted[:, side[x]], tests.bits), tests.remain[side[x]]))
        low, high = bound(keys, tests.keys, False), bound(keys, tests.upper, True)
        of = np.flatnonzero(high > low)
        if len(of):
            counts = (high - low)[of]
            asked = np.repeat(of, counts)
            spot = suffixes[np.repeat(low[of], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)]
            depth = tests.depth[asked]
            np.add.at(hit, spot, 1)
            np.add.at(hit, spot + depth, -1)
            row_of = np.zeros(len(ids), np.int64)
            row_of[place] = row
            rows = row_of[spot]
            many_items = np.array([len(tests.items[q]) for q in of])
            items = np.concatenate([tests.items[q] for q in of])
            offset = np.repeat(np.cumsum(many_items) - many_items, counts)
            many = np.repeat(many_items, counts)
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            pairs = np.unique(np.column_stack([np.repeat(rows, many), items[np.repeat(offset, many) + step]]), axis=0)
            # windows one after the other in both texts are one match, known by how far apart the texts are
            rank = np.empty(len(tests.text), np.int64)
            rank[tests.suffix] = np.arange(m)
            begin = tests.start[asked]
            order = np.lexsort((spot, spot - begin))
            spot, begin, depth = spot[order], begin[order], depth[order]
            last = np.r_[(np.diff(spot) != 1) | (np.diff(spot - begin) != 0), True]
            end = np.flatnonzero(last)[np.searchsorted(np.flatnonzero(last), np.arange(len(spot)))]
            spots.append(spot)
            starts.append(rank[begin])
            lengths.append(spot[end] + depth[end] - spot)
    spot, start, length = (np.concatenate(x) for x in (spots, starts, lengths))
    own = np.searchsorted(place, spot)
    rows, word = row[own], spot - row[own]
    word = word - np.searchsorted(row, np.arange(n_rows))[rows] if len(rows) else word
    real = length > 0
    rows, word, length, start = rows[real], word[real], length[real], start[real]
    longest, at = best(rows, length, word, n_rows)
    of_item, at_item = best(tests.owner[start], length, word + (rows << 32), n_items)
    pick = lambda values, at: np.where(at >= 0, values[np.maximum(at, 0)] if len(values) else -1, -1)
    return Found(np.cumsum(hit)[place] > 0, pairs, longest, pick(word, at), of_item, pick(rows, at_item), pick(word, at_item))


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, match_at long"


def digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def shards(column: pa.Array, blocks: list):
    """(first row, rows, words of each row, hit, names of items by row, longest, where) of each shard, over all blocks."""
    for a, b, row, found in hashed_words(column, SHARD_BYTES):
        n = b - a
        hit, names = np.zeros(len(row), bool), [set() for _ in range(n)]
        longest, where = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        for tests in blocks:
            got = search(tests, row, found, n)
            hit |= got.hit
            for r, i in got.pairs.tolist():
                names[r].add(tests.names[i])
            better = (got.longest > longest) | ((got.longest == longest) & (got.longest > 0) & (got.where < where))
            longest, where = np.where(better, got.longest, longest), np.where(better, got.where, where)
        yield a, n, row, hit, names, longest, where


def tests_of(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, max_bytes: int = MAX_BYTES):
    """The benchmark in passes: lists of broadcast blocks of about ``block_bytes`` of text each, ``max_bytes`` together.

    Items are dealt to blocks by a hash of their id. The driver holds one block at a time; a pass's blocks are
    gone once the next is asked for.
    """
    spark = benchmark.sparkSession
    rows = benchmark.where("text IS NOT NULL").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n, held = math.ceil(total / block_bytes), []
    for i in range(n):
        mine = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i).collect()  # one block
        held.append(spark.sparkContext.broadcast(block([(r.item_id, r.text) for r in mine], window)))
        if (len(held) + 1) * block_bytes > max_bytes and i < n - 1:
            yield held
            for b in held:
                b.unpersist()
            held = []
    yield held


def scanned(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_bytes: int = MAX_BYTES) -> DataFrame:
    """A row per document with what it shares with the benchmark.

    n_hit counts its words inside occurrences of a window of ``window`` test words (a shorter item is one
    window); n_items and items_sha256 tell the items, longest_match and match_at the longest verbatim match
    in words, of any length, and the word where it starts (null without one; the first if several are as long).
    A null text has no words. Items without id count under an empty name; items that share an id are one. Texts
    of any length count whole, equal rows get equal results.
    """
    passes = tests_of(benchmark, window, max_bytes=max_bytes)
    first = next(passes)
    more = [written(_parts(documents, first), "shared")] if (second := next(passes, None)) is not None else []
    if not more:
        return _whole(documents, first)
    while second is not None:
        more.append(written(_parts(documents, second), "shared"))
        second = next(passes, None)
    every = more[0]
    for x in more[1:]:
        every = every.union(x)
    spans_ = F.array_sort(F.flatten(F.collect_list("spans")))
    covered = F.aggregate(spans_, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("upto")), lambda s, x: F.struct(
        (s["n"] + F.greatest(F.lit(0).cast("long"), x["b"] - F.greatest(x["a"], s["upto"]))).alias("n"), F.greatest(s["upto"], x["b"]).alias("upto")))["n"]
    names = F.array_distinct(F.array_sort(F.flatten(F.collect_list("items"))))
    found = every.distinct().groupBy("k1", "k2").agg(covered.alias("n_hit"), names.alias("items"), F.max(F.struct("longest", (-F.col("at")).alias("back"))).alias("best"))
    rows = keyed(documents).select("doc_id", "k1", "k2", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda x: x != "")).cast("long").alias("n_words"))
    rows = rows.join(found, ["k1", "k2"], "left")
    n_hit, own = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(own).cast("long").alias("n_items"), F.sha2(F.array_join(own, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.coalesce("best.longest", F.lit(0)).alias("longest_match"), (-F.col("best.back")).alias("match_at"))


def _whole(documents: DataFrame, blocks: list) -> DataFrame:
    schema = T.StructType([documents.schema["doc_id"], *T._parse_datatype_string(RESULT).fields])

    def scan(batches):
        tests = [b.value for b in blocks]
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for _, n, row, hit, names, longest, where in shards(batch.column(1), tests):
                n_hit = np.bincount(row[hit], minlength=n)
                cols = np.bincount(row, minlength=n).tolist(), n_hit.tolist(), [len(x) for x in names], [digest(list(x)) for x in names], (n_hit > 0).tolist(), longest.tolist(), [x if x >= 0 else None for x in where.tolist()]
                for col, x in zip(out, cols, strict=True):
                    col += x
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out, types, strict=True))], schema.names)

    return documents.select("doc_id", "text").mapInArrow(scan, schema)


def _parts(documents: DataFrame, blocks: list) -> DataFrame:
    """k1, k2, spans of hit words, items, and the longest match of the rows that share a word with some blocks."""

    def scan(batches):
        tests = [b.value for b in blocks]
        for batch in batches:
            rows = []
            for a, n, row, hit, names, longest, where in shards(batch.column(2), tests):
                edge = np.searchsorted(row, np.arange(n + 1))
                for r in np.flatnonzero(longest).tolist():
                    mine = np.r_[False, hit[edge[r] : edge[r + 1]], False]
                    turns = np.flatnonzero(mine[1:] != mine[:-1]).reshape(-1, 2).tolist()
                    rows.append((a + r, [{"a": x, "b": y} for x, y in turns], sorted(names[r]), int(longest[r]), int(where[r])))
            at = pa.array([x[0] for x in rows], pa.int64())
            span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            kinds = [span, pa.list_(pa.string()), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array([x[k + 1] for x in rows], t) for k, t in enumerate(kinds))], ["k1", "k2", "spans", "items", "longest", "at"])

    return keyed(documents).select("k1", "k2", "text").mapInArrow(scan, "k1 long, k2 long, spans array<struct<a:long,b:long>>, items array<string>, longest long, at long")


def matches(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The longest verbatim match of each item: item_id, words, doc_id and the word where it starts; of equals the smallest doc_id's first."""
    out = None
    for blocks in tests_of(benchmark, window):
        schema = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("words", T.LongType()), documents.schema["doc_id"], T.StructField("at", T.LongType())])

        def scan(batches, blocks=blocks, schema=schema):
            for batch in batches:
                for a, b, row, found in hashed_words(batch.column(1), SHARD_BYTES):
                    for tests in (x.value for x in blocks):
                        got = search(tests, row, found, b - a)
                        on = np.flatnonzero(got.of_item)
                        ids = batch.column(0).take(pa.array(a + got.at_row[on]))
                        yield pa.RecordBatch.from_arrays([pa.array([tests.names[i] for i in on.tolist()], pa.string()), pa.array(got.of_item[on]), ids, pa.array(got.at_word[on])], schema.names)

        best_ = documents.select("doc_id", "text").mapInArrow(scan, schema).groupBy("item_id").agg(F.min(F.struct((-F.col("words")).alias("w"), "doc_id", "at")).alias("x"))
        mine = written(best_.select("item_id", (-F.col("x.w")).alias("words"), "x.doc_id", "x.at"), "matches")
        out = mine if out is None else out.union(mine)
    return out


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The documents that share no window with the benchmark, all columns as they were."""
    at = documents.columns.index("text")
    for blocks in tests_of(benchmark, window, max_bytes=max_bytes):
        before = documents

        def scan(batches, blocks=blocks):
            tests = [b.value for b in blocks]
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for a, _, row, hit, _, _, _ in shards(batch.column(at), tests):
                    keep[a + np.unique(row[hit])] = False
                yield batch.filter(pa.array(keep))

        documents = before.mapInArrow(scan, before.schema)
    return documents
