"""Suffix-array dedup: bytes inside any 400-byte string that starts at two places go.

Sorting every suffix would move hundreds of times the input. Instead each text marks anchors: of the 201
places where a 400-byte string may hold a 200-byte piece, the one with the smallest hash. Equal strings
mark the same anchor, so their suffixes from there are equal too, and about one suffix in a hundred stays.

1. Suffixes at anchors, as tokens of 200 bytes each (64-bit hashes), are dealt to buckets by sampled
   splitters on their leading tokens and then on their place, so that a bucket stays bounded even if one
   passage makes up much of the corpus. A bucket sorts its suffixes by multikey quicksort, neighbours compare
   tokens, and the ends of buckets are compared across their boundaries. Only suffixes whose first token
   repeats can belong to a repeated string; where two tokens repeat, the 400 bytes from the anchor do.
2. Anchors also carry the hash of all bytes that their strings span. Where that repeats, all their strings do.
   What lies between two repeated strings less than 400 bytes apart is covered. Only the edges of repeated
   regions are open: there, the 400-byte strings of the anchors that share an edge's piece are compared by
   hash, one anchor for each different span.
3. Each document drops the union of its repeated strings.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import U, parts, prefix, spans
from .rows import keyed
from .scratch import dropped, written

SPAN, LEAD, SLICE = 400, 200, 1 << 20
CHOICES = SPAN - LEAD + 1
#: Splitters come from the suffixes of about so many documents.
SAMPLE_DOCUMENTS = 2000


def anchors(data: np.ndarray, sums: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of data[begin:end] and the first and last start of the 400-byte strings that mark each, from begin."""
    n = end - begin - LEAD + 1
    at = np.arange(begin, begin + n)
    value = (spans(sums, at, at + LEAD) & U(0xFFFFFFFF00000000)) | np.arange(n, dtype=U)
    size = 1  # smallest of each run of CHOICES pieces, the leftmost among equal hashes
    while 2 * size <= CHOICES:
        value = np.minimum(value[:-size], value[size:])
        size *= 2
    value = np.minimum(value[: n - CHOICES + 1], value[CHOICES - size : CHOICES - size + n - CHOICES + 1])
    chosen = (value & U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    return chosen[first], first, np.r_[first[1:], len(chosen)] - 1


def suffixes(column: pa.Array):
    """(row, place, token 1, token 2, own, span) of all anchors of a column, in slices; token 2 is 0 where the text ends before.

    own packs how far before the anchor its strings start: 256 times the farthest plus the nearest. span is the
    hash of all bytes that those strings cover.
    """
    for a, b, data, ends in parts(column, SLICE):
        sums = prefix(data)
        rows, places, owns, begins = [], [], [], []
        for r in range(b - a):
            if ends[r + 1] - ends[r] >= SPAN:
                at, low, high = anchors(data, sums, int(ends[r]), int(ends[r + 1]))
                rows.append(np.full(len(at), a + r))
                places.append(at)
                owns.append((at - low) * 256 + at - high)
                begins.append(at + ends[r])
        if rows:
            row, place, start = np.concatenate(rows), np.concatenate(places), np.concatenate(begins)
            whole = start + SPAN <= ends[row - a + 1]
            one = spans(sums, start, start + LEAD)
            two = np.where(whole, spans(sums, np.minimum(start + LEAD, len(data)), np.minimum(start + SPAN, len(data))) | U(1), U(0))
            own = np.concatenate(owns)
            yield row, place, one, two, own, spans(sums, start - own // 256, start - own % 256 + SPAN)


def sort_keys(one: np.ndarray, two: np.ndarray, k1: np.ndarray, k2: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Suffixes as byte strings in sorting order: tokens, then the place, which tells equal ones apart."""
    flip = U(1 << 63)
    cols = np.stack([one, two, k1.view(U) ^ flip, k2.view(U) ^ flip, place.astype(U)], axis=1)
    return cols.astype(">u8").view("S40").ravel()


def multikey(columns: list[np.ndarray]) -> np.ndarray:
    """Order by the first column, then runs of equal values by the next, as multikey quicksort does."""
    order = np.argsort(columns[0], kind="quicksort")
    run = np.cumsum(np.r_[False, columns[0][order][1:] != columns[0][order][:-1]]) if len(order) else order
    for column in columns[1:]:
        tied = np.flatnonzero(np.r_[False, run[1:] == run[:-1]] | np.r_[run[1:] == run[:-1], False]) if len(order) else order
        if not len(tied):
            break
        sub = order[tied]
        order[tied] = sub[np.lexsort((column[sub], run[tied]))]
        new = np.r_[False, (run[1:] != run[:-1]) | (column[order][1:] != column[order][:-1])]
        run = np.cumsum(new)
    return order


SUFFIX = "bucket int, one long, two long, span long, k1 long, k2 long, place int, own int"


def _dealt(rows: DataFrame, splitters) -> DataFrame:
    def deal(batches):
        cuts = np.array(splitters.value, "S40") if splitters is not None else np.zeros(0, "S40")
        for batch in batches:
            k1, k2 = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for row, place, one, two, own, span in suffixes(batch.column(0)):
                bucket = np.searchsorted(cuts, sort_keys(one, two, k1[row], k2[row], place), side="right").astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket), *(pa.array(x.view(np.int64)) for x in (one, two, span)), pa.array(k1[row]), pa.array(k2[row]), pa.array(place.astype(np.int32)), pa.array(own.astype(np.int32))],
                    ["bucket", "one", "two", "span", "k1", "k2", "place", "own"],
                )

    return rows.select("text", "k1", "k2").mapInArrow(deal, SUFFIX)


def _splitters(rows: DataFrame, n: int) -> list[bytes]:
    """n - 1 sampled splitters of all suffixes, from documents whose name hashes low; at most 16 n keys reach the driver."""
    total = rows.count()
    sample = _dealt(rows.where(F.pmod(F.xxhash64("k1", "k2"), F.lit(max(1, total // SAMPLE_DOCUMENTS))) == 0), None)
    some = sample.orderBy(F.xxhash64("k2", "place")).limit(16 * n).collect()
    if not some:
        return []
    col = lambda name: np.array([r[name] for r in some], np.int64)
    keys = np.sort(sort_keys(col("one").view(U), col("two").view(U), col("k1"), col("k2"), col("place")))
    return sorted({keys[len(keys) * i // n] for i in range(1, n)})


def repeated_suffixes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Anchored suffixes whose first token repeats: k1, k2, place, own, one, span, and whether both tokens do; and the scratch table they are read from."""
    spark = rows.sparkSession
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    splitters = spark.sparkContext.broadcast(_splitters(rows, n))  # one key per bucket

    def compare(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        bucket, one, two, span, k1, k2, place, own = (c.to_numpy() for c in table.columns)
        order = multikey([one.view(U), two.view(U), k1, k2, place])
        one, two = one[order], two[order]
        first = one[1:] == one[:-1]
        both = first & (two[1:] == two[:-1]) & (two[1:] != 0)
        rep1, rep2 = np.r_[False, first] | np.r_[first, False], np.r_[False, both] | np.r_[both, False]
        edge = np.zeros(len(order), np.int32)  # 1 first of the bucket, 2 last, 3 both
        edge[0] |= 1
        edge[-1] |= 2
        keep = np.flatnonzero(rep1 | (edge > 0))
        cols = [bucket[order][keep], edge[keep], one[keep], two[keep], span[order][keep], k1[order][keep], k2[order][keep], place[order][keep], own[order][keep], rep1[keep], rep2[keep]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["bucket", "edge", "one", "two", "span", "k1", "k2", "place", "own", "rep1", "rep2"])

    schema = "bucket int, edge int, one long, two long, span long, k1 long, k2 long, place int, own int, rep1 boolean, rep2 boolean"
    table = written(_dealt(rows, splitters).repartitionById(n, F.col("bucket")).mapInArrow(compare, schema), "suffixes")
    ends = table.where("edge > 0").select("bucket", "edge", "one", "two").orderBy("bucket", "edge").collect()  # two a bucket at most
    fixed = {}
    for x, y in zip(ends, ends[1:]):
        if x.bucket != y.bucket and x.one == y.one:
            for r in (x, y):
                old = fixed.get((r.bucket, r.edge), False)
                fixed[r.bucket, r.edge] = old or (x.two == y.two and x.two != 0)
    across = spark.createDataFrame([(b, e, w) for (b, e), w in fixed.items()], "bucket int, edge int, both boolean")
    found = table.join(F.broadcast(across), ["bucket", "edge"], "left")  # no more than two rows a bucket
    whole = F.col("rep2") | F.coalesce("both", F.lit(False))
    return found.where("rep1 OR both IS NOT NULL").select("k1", "k2", "place", "own", "one", "span", whole.alias("whole")), table


def _listed(rows: DataFrame, *names: str) -> DataFrame:
    return rows.groupBy("k1", "k2").agg(F.collect_set(F.struct(*names)).alias("marks"))


def _flat(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Row of each list entry, and the entries' fields."""
    offsets = column.offsets.to_numpy()
    entries = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    row = np.repeat(np.arange(len(column)), np.diff(offsets))
    return row, {entries.type.field(i).name: entries.field(i).to_numpy(zero_copy_only=False) for i in range(entries.type.num_fields)}


def open_edges(found: DataFrame) -> DataFrame:
    """Anchors at edges of repeated regions, and one for each other span that shares their piece: k1, k2, place, own.

    ``found`` has ``same``, whether the whole span repeats.
    """

    def edges(batches):
        for batch in batches:
            row, x = _flat(batch.column(2))
            order = np.lexsort((x["place"], row))
            row, place, own, one, span = row[order], x["place"][order].astype(np.int64), x["own"][order], x["one"][order], x["span"][order]
            whole, same = x["whole"][order], x["same"][order]
            low, high = place - own // 256, place - own % 256
            base = row.astype(np.int64) << 40
            q = np.unique(np.concatenate([(base + place)[whole], (base + low)[same], (base + high)[same]]))
            if len(q):
                last = np.flatnonzero(np.r_[q[1:] - q[:-1] > SPAN, True])
                reach = q[last[np.searchsorted(last, np.arange(len(q)))]]
                i = np.searchsorted(q, base + low, side="right") - 1
                ok = (i >= 0) & (q[np.maximum(i, 0)] >= base) & (reach[np.maximum(i, 0)] >= base + high)
            else:
                ok = np.zeros(len(row), bool)
            k1, k2 = batch.column(0).to_numpy()[row], batch.column(1).to_numpy()[row]
            cols = [k1, k2, place.astype(np.int32), own, one, span, ~ok]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["k1", "k2", "place", "own", "one", "span", "open"])

    marked = _listed(found, "place", "own", "one", "span", "whole", "same").mapInArrow(edges, "k1 long, k2 long, place int, own int, one long, span long, open boolean")
    each = marked.groupBy("one", "span").agg(F.min(F.struct("k1", "k2", "place", "own")).alias("at"), F.bool_or("open").alias("open"))
    each = written(each, "edges")
    return each.join(each.where("open").select("one").distinct(), "one", "left_semi").select("at.*")


def repeated_windows(rows: DataFrame, at: DataFrame) -> DataFrame:
    """Starts of 400-byte strings that repeat, among those that mark the given anchors: k1, k2, place."""

    def windows(batches):
        for batch in batches:
            row, x = _flat(batch.column(4))
            order = np.argsort(row, kind="stable")
            row, place, own = row[order], x["place"][order].astype(np.int64), x["own"][order]
            edges = np.searchsorted(row, np.arange(batch.num_rows + 1))
            k1, k2 = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for a, b, data, ends in parts(batch.column(1), SLICE):
                sums = prefix(data)
                mine = slice(edges[a], edges[b])
                r, p, o = row[mine], place[mine], own[mine]
                low, count = p - o // 256, o // 256 - o % 256 + 1
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                r, p, start = np.repeat(r, count), np.repeat(p, count), np.repeat(low, count) + step
                base = ends[r - a]
                piece, string = spans(sums, base + p, base + p + LEAD), spans(sums, base + start, base + start + SPAN)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(piece.view(np.int64)), pa.array(string.view(np.int64)), pa.array(k1[r]), pa.array(k2[r]), pa.array(start.astype(np.int32))], ["piece", "string", "k1", "k2", "place"]
                )

    texts = rows.join(_listed(at, "place", "own"), ["k1", "k2"]).select("doc_id", "text", "k1", "k2", "marks")
    cut = texts.mapInArrow(windows, "piece long, string long, k1 long, k2 long, place int")
    cut = cut.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "piece", "string")  # once, for grouping and join
    again = cut.groupBy("piece", "string").agg(F.count("*").alias("n")).where("n > 1").select("piece", "string")
    return cut.join(again, ["piece", "string"], "left_semi").select("k1", "k2", "place")


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _removed(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which bytes repeated strings cover."""
    depth = np.zeros(len(data) + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, starts + SPAN, -1)
    return np.cumsum(depth)[:-1] > 0


def marked(documents: DataFrame) -> DataFrame:
    """doc_id, text, k1, k2 of each row with marks, the starts of its repeated strings (null if there are none)."""
    rows = keyed(documents)
    found, table = repeated_suffixes(rows)
    again = found.groupBy("one", "span").agg(F.count("*").alias("n")).where("n > 1").select("one", "span", F.lit(True).alias("same"))
    found = written(found.join(again, ["one", "span"], "left").withColumn("same", F.coalesce("same", F.lit(False))), "spans")
    dropped(table)
    ends = F.explode(F.array(F.expr("CAST(place - own DIV 256 AS INT)"), F.expr("place - own % 256")))
    starts = found.where("whole").select("k1", "k2", "place").union(found.where("same").select("k1", "k2", ends.alias("place")))
    starts = starts.union(repeated_windows(rows, open_edges(found)))
    return rows.join(_listed(starts, "place"), ["k1", "k2"], "left").select("doc_id", "text", "k1", "k2", "marks")


def deduplicated(documents: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Matches stay within a document and count within one as well as across. A null text is an empty one;
    texts of fewer than 400 bytes stay whole. A row that occurs twice matches itself and goes.
    """
    found = marked(documents)
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, {RESULT}"

    def cut(batches):
        for batch in batches:
            row, x = _flat_or_none(batch.column(4))
            edges = np.searchsorted(row, np.arange(batch.num_rows + 1))
            out: list[list] = [[], [], [], []]
            for a, b, data, ends in parts(batch.column(1), SLICE):
                for r in range(a, b):
                    text = data[ends[r - a] : ends[r - a + 1]]
                    gone = _removed(text, x[edges[r] : edges[r + 1]])
                    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
                    for col, v in zip(out, (len(text), int(gone.sum()), runs, hashlib.sha256(text[~gone].tobytes()).hexdigest()), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return found.mapInArrow(cut, schema)


def _flat_or_none(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Like _flat for lists of places, some of which are null."""
    lists = column.to_pylist() if column.null_count == len(column) else None
    if lists is not None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    import pyarrow.compute as pc

    row = pc.list_parent_indices(column).to_numpy()
    return row, pc.list_flatten(column).field(0).to_numpy().astype(np.int64)
