"""Line dedup: keep one occurrence of every group of nearly equal lines.

Lines are normalised, which changes case and white space alone, and equal ones become one node before anything is
compared; digits and signs count as other characters do, so rows of a table or a log link only where nine tenths of
their characters agree. A line's SimHash comes in blocks: its features, which are its words, are dealt to classes by
hash, and each class is one block. An edit touches the classes of the few features that it takes or brings, so two
lines that differ in fewer features than they have classes agree in a block for certain (pigeonhole); several
dealings make that likely for more. Lines that share a block are candidates, the distance of whole SimHashes thins
them out, and the edit similarity of their texts decides. Short lines have too few words: those up to SHORT characters meet by sketches of their runs
of four bytes, those up to TINY when they share a key among the line and the line less one character.

Block keys travel as packed bytes with what thins out their lines, a part for each range of keys, and leave it as pairs
that fit, or as rows where many lines share one. Keys that are frequent within a task are
settled there, so that no part gathers a frequent key.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .edits import close, distance, least, small, tallies
from .flat import U, mixed, parts, prefix, spans
from .linking import BLOCK_WEIGHT, SMALL, celled, centred, groups_of, linked, pairs_in
from .near_duplicates import sketches
from .rows import fresh, keyed, row_keys
from .scratch import dropped, written
from .substrings import _flat

#: Lines with fewer bytes than the last never go. One edit of nine characters is more than a tenth: such lines link when equal.
PERCENT, MIN_BYTES = 90, 1
#: Lengths in characters: up to TINY deletions are keys, below SHORT sketches, from LONG on blocks.
TINY, SHORT, LONG, COORDINATES, MAX_BITS = 19, 96, 86, 128, 24
#: (shortest line, classes, dealings); a line belongs to every tier that lines of nine tenths to all of its length reach.
TIERS = ((96, 5, 5), (128, 9, 2), (256, 16, 1), (512, 24, 1), (1024, 32, 1))
FEW = 6
#: A block speaks for a line if its features have so many bytes beyond two each.
LEAST = 9
STEP = U(0x9E3779B97F4A7C15)
FOLD = np.arange(256, dtype=np.uint8)  # white space but line ends becomes a space, A-Z lower case
FOLD[[*range(10), *range(11, 32), 127]] = 32
FOLD[65:91] += 32
#: Bytes between words: spaces, line ends and ASCII punctuation, which stays in the text that is compared.
BETWEEN = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
#: A byte's bits as eight counts of a byte each.
LANES = np.array([sum((v >> j & 1) << (8 * j) for j in range(8)) for v in range(256)], U)


def folded(data: np.ndarray) -> np.ndarray:
    """Lower-case bytes with spaces for white space, no-break and ideographic spaces included; digits and signs stay."""
    out = FOLD[data]
    near = np.r_[data[1:], np.zeros(2, np.uint8)]
    wide = np.flatnonzero((data == 0xE3) & (near[:-1] == 0x80) & (near[1:] == 0x80))
    for k in range(3):
        out[wide + k] = 32
    latin = np.flatnonzero((data == 0xC2) & (near[:-1] == 0xA0))
    out[latin] = out[latin + 1] = 32
    return out


def lines_of(column: pa.Array, limit: int = 1 << 18):
    """(bytes, start, end, row, number) of the normalised lines of slices of a column; a line end stands after each."""
    column = pc.fill_null(pc.utf8_lower(column.cast(pa.large_string())), "")
    for a, b, data, ends in parts(pc.binary_join_element_wise(column.cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary())), limit):
        out = folded(data)
        n_lines = np.diff(np.searchsorted(np.flatnonzero(out == 10), ends))
        gap = (out == 32) | (out == 10)
        out = out[(out != 32) | np.r_[False, ~gap[:-1]]]
        out = out[(out != 32) | np.r_[out[1:] != 10, True]]
        end = np.flatnonzero(out == 10)
        start = np.r_[0, end[:-1] + 1][: len(end)]
        row = np.repeat(np.arange(a, b), n_lines)
        number = np.arange(len(end)) - np.repeat(np.cumsum(n_lines) - n_lines, n_lines)
        yield out, start, end, row, number


def characters(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    seen = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    return seen[end] - seen[start]


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line, hash and bytes of each feature: words, which also end where four bytes hash low, one place in sixteen."""
    n = len(data)
    inside = ~BETWEEN[data]
    x = data.astype(np.uint32)
    four = x.copy()
    for k in range(1, 4):
        four[k:] |= x[:-k] << np.uint32(8 * k)
    cut = np.zeros(n, bool)
    cut[1:] = inside[:-1] & ((four[:-1] * np.uint32(2654435761)) >> np.uint32(28) == 0)
    for k in range(4):  # four bytes of this line
        at = start + k
        cut[at[at < n]] = False
    begins = inside & (~np.r_[False, inside[:-1]] | cut)
    edges = np.flatnonzero(~inside | begins)
    which = np.flatnonzero(begins[edges])
    first, last = edges[which], np.r_[edges, n][which + 1]
    low = np.searchsorted(first, start)
    counts = np.searchsorted(first, end) - low
    mine = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    first, last = first[mine], last[mine]
    return np.repeat(np.arange(len(start)), counts), spans(sums, first, last), last - first


def simhash(line: np.ndarray, found: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """64 bits of each line: whether most of its features of four bytes and more have the bit. Features come in order of lines."""
    line, found = line[size >= 4], mixed(found[size >= 4] + U(5))
    counts = np.bincount(line, minlength=n)
    out = np.zeros(n, U)
    if not len(line):
        return out
    mine = np.flatnonzero(counts)
    first = (np.cumsum(counts) - counts)[mine]
    lanes = LANES[found.view(np.uint8)].reshape(-1, 8)  # eight counts of a byte each, so parts of a line of up to 255 features
    many = np.flatnonzero(counts[mine] > 255).tolist()
    step = np.sort(np.concatenate([first, *(np.arange(first[i] + 255, first[i] + counts[mine[i]], 255) for i in many)]))
    sums = np.add.reduceat(lanes, step, axis=0).view(np.uint8)
    if len(step) > len(first):
        sums = np.add.reduceat(sums, np.searchsorted(step, first), axis=0, dtype=np.int64)
    out[mine] = np.packbits(2 * sums.astype(np.int64) > counts[mine, None], axis=1, bitorder="little").view(U).ravel()
    return out


def blocks(line: np.ndarray, found: np.ndarray, size: np.ndarray, n: int, tier: int) -> tuple[np.ndarray, np.ndarray]:
    """Line and key of each block of a tier's dealings; blocks of hardly any bytes stay out."""
    _, classes, dealings = TIERS[tier]
    one, two = (mixed(found + U(77)) >> U(24)).astype(np.float64), (mixed(found + U(78)) >> U(40)).astype(np.float64)
    rows, keys = [], []
    for r in range(dealings):
        slot = line * classes + (mixed(found + U((r + 1) * int(STEP) % (1 << 64))) % U(classes)).astype(np.int64)
        told = np.flatnonzero(np.bincount(slot, np.maximum(size - 2, 0), n * classes) >= LEAST)
        a, b = (np.bincount(slot, x, n * classes)[told].astype(U) for x in (one, two))
        keys.append(mixed(mixed(a + U(tier * 64 + r)) * STEP + b + (told % classes).astype(U)))
        rows.append(told // classes)
    return np.concatenate(rows), np.concatenate(keys)


def bands(sums: np.ndarray, start: np.ndarray, end: np.ndarray, width: int = 4, rows: int = 4) -> np.ndarray:
    """Band keys of the sketches of each line's runs of ``width`` bytes."""
    n = COORDINATES // rows
    count = np.maximum(end - start - width + 1, 0)
    line = np.repeat(np.arange(len(start)), count)
    at = np.repeat(start, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    split = sketches(line, spans(sums, at, at + width), len(start), COORDINATES)[:, : n * rows].reshape(len(start), n, rows)
    keys = np.zeros((len(start), n), U)
    for k in range(rows):
        keys = mixed(keys * U(0xD1342543DE82EF95) + split[:, :, k])
    return mixed(keys + np.arange(1, n + 1, dtype=U) * STEP + U(width))


def line_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Line and bucket key of all keys of some lines, and each line's SimHash and characters; ``sums`` are the prefix sums of the bytes."""
    size = characters(data, start, end)
    line, found, bytes_ = features(data, start, end, sums)
    rows, keys = [], []
    for t, (low, _, _) in enumerate(TIERS):
        high = TIERS[t + 1][0] if t + 1 < len(TIERS) else math.inf
        mine = ((10 * size >= 9 * low) & (size < high))[line]
        if mine.any():
            r, k = blocks(line[mine], found[mine], bytes_[mine], len(start), t)
            rows.append(r)
            keys.append(k)
    told = np.bincount(np.concatenate(rows), minlength=len(start)) if rows else np.zeros(len(start), np.int64)
    short = np.flatnonzero((size >= TINY - 1) & ((size < SHORT) | (told < FEW)))  # lines of few different words have few blocks
    if len(short):
        k = bands(sums, start[short], end[short])
        rows.append(np.repeat(short, k.shape[1]))
        keys.append(k.ravel())
    for i in np.flatnonzero((size >= 10) & (size <= TINY)).tolist():
        x = data[start[i] : end[i]].tobytes().decode("utf-8", "replace")
        less = [y.encode() for y in sorted({x, *(x[:k] + x[k + 1 :] for k in range(len(x)))})]
        ends = np.r_[0, np.cumsum([len(y) for y in less])]
        rows.append(np.full(len(less), i))
        keys.append(mixed(spans(prefix(np.frombuffer(b"".join(less), np.uint8)), ends[:-1], ends[1:]) + U(TINY)))
    none = np.zeros(0, np.int64)
    bits = simhash(line, found, bytes_, len(start))
    bits[2 * np.bincount(line[bytes_ >= 4], bytes_[bytes_ >= 4], len(start)) < end - start] = 0  # mostly signs or short words
    return np.concatenate([*rows, none]), np.concatenate([*keys, none.view(U)]), bits, size


def bucket_keys(lines: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """The bucket keys and the SimHash of each normalised line."""
    made = [x.encode("utf-8", "surrogatepass") for x in lines]
    end = np.cumsum([len(x) + 1 for x in made]) - 1
    data = np.frombuffer(b"".join(x + b"\n" for x in made), np.uint8)
    rows, keys, bits, _ = line_keys(data, end - [len(x) for x in made], end, prefix(data))
    order = np.argsort(rows, kind="stable")
    return np.split(keys[order], np.searchsorted(rows[order], np.arange(1, len(lines)))), bits


NAMES = ["n", "bits"]
#: Lines in a block of a cell whose texts are compared in one task, pairs whose distance is bounded at once, and pairs to compare at once.
BLOCK, SLICE, TRIED = 512, 1 << 14, 1 << 18


def near(x: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether two lines' lengths and SimHashes, where both have one that tells, allow a link."""
    low, high = np.minimum(x["n"][a], x["n"][b]), np.maximum(x["n"][a], x["n"][b])
    return (100 * low.astype(np.int64) >= percent * high.astype(np.int64)) & ((low < LONG) | (x["bits"][a] == 0) | (x["bits"][b] == 0) | (np.bitwise_count((x["bits"][a] ^ x["bits"][b]).view(U)) <= MAX_BITS))


def fits(percent: int) -> str:
    return f"100 * least(s.n, t.n) >= {percent} * greatest(s.n, t.n) AND (least(s.n, t.n) < {LONG} OR s.bits = 0 OR t.bits = 0 OR bit_count(s.bits ^ t.bits) <= {MAX_BITS})"


def placed_lines(rows: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """doc_id, k1, k2, line number, name and characters of every line of ``min_bytes`` bytes and more."""
    schema = T.StructType([rows.schema["doc_id"], *T._parse_datatype_string("k1 long, k2 long, line int, node long, n int").fields])

    def scan(batches):
        for batch in batches:
            for data, start, end, row, number in lines_of(batch.column(3)):
                keep = np.flatnonzero(end - start >= min_bytes)
                start, end = start[keep], end[keep]
                at = pa.array(row[keep])
                cols = [number[keep].astype(np.int32), spans(prefix(data), start, end).view(np.int64), characters(data, start, end).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(3)), *map(pa.array, cols)], schema.names)

    return rows.select("doc_id", "k1", "k2", "text").mapInArrow(scan, schema)


#: Kinds of packed parts.
KEYS, SETTLED = range(2)
#: Entries of a packed part of keys: five bytes of the key, whose others name the part, and the node. HEAVY: so often in one
#: flush, a key is settled there (ELSEWHERE marks its first entry). LENGTHY: the line is not below LONG. SEEN: places of a task's memory of lines whose keys it has sent.
ENTRY, FLUSH, HEAVY, SEEN, PART_ENTRIES = 13, 1 << 19, 64, 1 << 18, 1 << 21
ELSEWHERE, LENGTHY = 128, 127


def packed(keys: np.ndarray, nodes: np.ndarray) -> bytes:
    out = np.empty((len(keys), ENTRY), np.uint8)
    out[:, :5] = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    out[:, 5:] = nodes.astype("<u8").view(np.uint8).reshape(-1, 8)
    return out.tobytes()


def unpacked(part: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(data, np.uint8).reshape(-1, ENTRY)
    keys = np.zeros((len(x), 8), np.uint8)
    keys[:, :5] = x[:, :5]
    return keys.view("<u8").ravel() | U(part << 40), np.ascontiguousarray(x[:, 5:]).view("<u8").ravel()


def told(size: np.ndarray, bits: np.ndarray, elsewhere: np.ndarray) -> bytes:
    """A byte per entry with its line's characters; what does not fit there, and the SimHash, follow for lines that thinning by it may touch."""
    lengthy = size >= LONG
    return (np.where(lengthy, LENGTHY, size) + ELSEWHERE * elsewhere).astype(np.uint8).tobytes() + size[lengthy].astype("<i4").tobytes() + bits[lengthy].astype("<u8").tobytes()


def untold(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters, SimHash and whether the key is settled elsewhere, of the n entries of a part."""
    first = np.frombuffer(data, np.uint8, n)
    size, bits = (first & 127).astype(np.int32), np.zeros(n, U)
    lengthy = np.flatnonzero(size == LENGTHY)
    size[lengthy] = np.frombuffer(data, "<i4", len(lengthy), n)
    bits[lengthy] = np.frombuffer(data, "<u8", len(lengthy), n + 4 * len(lengthy))
    return size, bits, first >= ELSEWHERE


def flushed(keys: np.ndarray, nodes: np.ndarray, n_parts: int, size: np.ndarray | None = None, bits: np.ndarray | None = None):
    """(part, kind, bytes) for entries: those of frequent keys go to their node's part, settled, but for the first of each.

    With characters and SimHash of each entry's line, a fourth item packs those.
    """
    keys = (keys >> U(40)) % U(n_parts) << U(40) | keys & U((1 << 40) - 1)
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    new = np.r_[True, keys[1:] != keys[:-1]]
    times = np.diff(np.r_[np.flatnonzero(new), len(keys)])
    heavy = np.repeat(times >= HEAVY, times)
    part = keys >> U(40)
    for kind, mine in ((KEYS, ~heavy | new), (SETTLED, heavy)):
        at = np.flatnonzero(mine)
        for p, some in parted(nodes[at] % U(n_parts) if kind == SETTLED else part[at]):
            some = at[some]
            data = keys[some].tobytes() + nodes[some].tobytes() if kind == SETTLED else packed(keys[some], nodes[some])
            yield (p, kind, data) if size is None else (p, kind, data, told(size[order[some]], bits[order[some]], heavy[some]))


def parted(part: np.ndarray):
    """(part, places) of each part."""
    order = np.argsort(part, kind="stable")
    edges = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1]]) if len(order) else order
    return [(int(part[some[0]]), some) for some in np.split(order, edges[1:])] if len(order) else []


def buckets(rows: DataFrame, n_parts: int, min_bytes: int = MIN_BYTES, percent: int = PERCENT) -> DataFrame:
    """(node, other) of every pair of lines that share a key of up to SMALL lines and fit, and (key, node, n, bits, times, bounded) of keys of more.

    Bounded is a key of up to BLOCK lines, not too long together and all in one task, that are paired with their centre (of most ``times``) there already.
    ``times`` is how many tasks or slices met the line with this key, which is enough to know the frequent ones.
    """

    def send(batches):
        seen = np.zeros(SEEN, np.int64)
        held: list[list[np.ndarray]] = []

        def flush():
            out = list(flushed(*(np.concatenate(x) for x in zip(*(h[:2] for h in held), strict=True)), n_parts, *(np.concatenate(x) for x in zip(*(h[2:] for h in held), strict=True)))) if held else []
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), *(pa.array([x[k] for x in out], pa.binary()) for k in (2, 3))], ["part", "kind", "data", "told"])

        for batch in batches:
            for data, start, end, _, _ in lines_of(batch.column(0)):
                keep = end - start >= min_bytes
                start, end = start[keep], end[keep]
                sums = prefix(data)
                node = spans(sums, start, end).view(np.int64)
                first = np.unique(node, return_index=True)[1]
                first = np.sort(first[seen[node[first] & (SEEN - 1)] != node[first]])
                seen[node[first] & (SEEN - 1)] = node[first]
                row, key, bits, size = line_keys(data, start[first], end[first], sums)
                if len(key):
                    held.append([key, node[first][row].view(U), size[row].astype(np.int32), bits[row]])
                if sum(len(h[0]) for h in held) >= FLUSH:
                    yield flush()
        yield flush()

    def meet(batches):
        sent: dict[int, list] = {KEYS: [], SETTLED: []}
        for batch in batches:
            for part, kind, data, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                both = np.frombuffer(data, U) if kind == SETTLED else None
                k, v = unpacked(part, data) if kind == KEYS else (both[: len(both) // 2], both[len(both) // 2 :])
                sent[kind].append((k, v, *untold(more, len(k))))
        for kind in (KEYS, SETTLED):
            if not (some := sent.pop(kind)):
                continue
            k, v, n, bits, elsewhere = (np.concatenate(x) for x in zip(*some, strict=True))
            del some
            order = np.lexsort((v, k))
            k, v = k[order], v[order]
            keep = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (v[1:] != v[:-1])])
            times = np.diff(np.r_[keep, len(k)]).astype(np.int32)
            elsewhere = np.maximum.reduceat(elsewhere[order], keep)
            k, v, n, bits = k[keep], v[keep].view(np.int64), n[order[keep]], bits[order[keep]].view(np.int64)
            new = np.r_[True, k[1:] != k[:-1]]
            c = np.diff(np.r_[np.flatnonzero(new), len(k)])
            elsewhere = np.repeat(np.maximum.reduceat(elsewhere, np.flatnonzero(new)), c)
            heavy = np.repeat(np.add.reduceat(n.astype(np.int64), np.flatnonzero(new)) > BLOCK_WEIGHT, c)
            c = np.repeat(c, c)
            large = (kind == SETTLED) | (c > 1) & elsewhere | (c > BLOCK) | (c > SMALL) & heavy
            bounded = ~large & (c > SMALL)
            x, found = {"n": n, "bits": bits}, [np.zeros((0, 2), np.int64)]
            few, some = np.flatnonzero(~large & (c > 1) & (c <= SMALL)), np.flatnonzero(bounded)
            order = some[np.lexsort((mixed(v[some].view(U)), times[some], k[some]))]
            last = np.flatnonzero(np.r_[k[order][1:] != k[order][:-1], True]) if len(some) else some
            centre = np.repeat(order[last], np.diff(np.r_[-1, last]))
            for a, b in (*((few[a], few[b]) for a, b in pairs_in(k[few])), (order[order != centre], centre[order != centre])):
                fit = near(x, a, b, percent)
                p, q = v[a[fit]], v[b[fit]]
                found.append(np.stack([np.minimum(p, q), np.maximum(p, q)], axis=1))
            pairs = np.unique(np.concatenate(found), axis=0)
            made = [pa.array(x[large | bounded]) for x in (k.view(np.int64), v, n, bits, times, bounded)]
            none = [pa.nulls(len(pairs), x.type) for x in made[2:]]
            yield pa.RecordBatch.from_arrays([*made, pa.nulls(len(made[0]), pa.int64())], names)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(pairs[:, 0]), *none, pa.array(pairs[:, 1])], names)

    names = ["key", "node", *NAMES, "times", "bounded", "other"]
    sent = rows.select("text").mapInArrow(send, "part int, kind int, data binary, told binary")
    return sent.repartitionById(n_parts, F.col("part")).mapInArrow(meet, "key long, node long, n int, bits long, times int, bounded boolean, other long")


def line_texts(rows: DataFrame, lines: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, text) of the asked nodes, each read from one place where it occurs."""
    one = lines.join(asked, "node", "left_semi").groupBy("node").agg(F.min(F.struct("k1", "k2", "line")).alias("at"))
    marks = one.select("at.k1", "at.k2", "at.line", "node").groupBy("k1", "k2").agg(F.collect_list(F.struct("line", "node")).alias("marks"))

    def read(batches):
        for batch in batches:
            asked_row, x = _flat(batch.column(1))
            order = np.argsort(asked_row.astype(np.int64) << 32 | x["line"], kind="stable")
            asked_row, line, node = asked_row[order], x["line"][order], x["node"][order]
            for data, start, end, row, number in lines_of(batch.column(0)):
                if len(row):
                    mine = slice(*np.searchsorted(asked_row, (row[0], row[-1] + 1)).tolist())
                    at = np.searchsorted(row.astype(np.int64) << 32 | number, asked_row[mine].astype(np.int64) << 32 | line[mine])
                    texts = [data[a:b].tobytes() for a, b in zip(start[at].tolist(), end[at].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(node[mine]), pa.array(texts, pa.binary()).cast(pa.string())], ["node", "text"])

    found = rows.select("k1", "k2", "text").join(marks, ["k1", "k2"]).select("text", "marks").mapInArrow(read, "node long, text string")
    return found.dropDuplicates(["node"])


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of ``percent`` hundredths of edit similarity."""
    for side in "ab":
        pairs = pairs.join(texts.select(F.col("node").alias(side), F.col("text").alias(f"t_{side}")), side)

    def compare(batches):
        for batch in batches:
            counts = [tallies(batch.column(k)) for k in (2, 3)]
            size = np.maximum(*(c.sum(axis=1) for c in counts))
            most = size * (100 - percent) // 100
            keep = least(*counts) <= most
            batch, most = batch.filter(pa.array(keep)), most[keep]
            at = np.arange(len(most))
            yield batch.filter(pa.array(close(pa.concat_arrays([batch.column(2), batch.column(3)]), at, at + len(at), most))).select(["a", "b"])

    return pairs.select("a", "b", "t_a", "t_b").mapInArrow(compare, "a long, b long")


def close_nodes(node: np.ndarray, lines: pa.Array, tried: np.ndarray, one: Callable[[str, str, int], int]) -> pa.RecordBatch:
    """The pairs of nodes whose lines are close, of columns (place, place, most); a pair that shares several buckets is compared once."""
    a, b, most = tried
    pair = np.stack([np.minimum(node[a], node[b]), np.maximum(node[a], node[b])], axis=1)
    pair, once = np.unique(pair, axis=0, return_index=True)
    found = np.flatnonzero(close(lines, a[once], b[once], most[once], one))
    return pa.RecordBatch.from_arrays([pa.array(pair[found, k]) for k in (0, 1)], ["a", "b"])


def across(rows: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The links (a, b) between different components of a bucket, a cell of two blocks at a time; only links leave the task.

    What characters two lines have bounds their distance; few pairs of unlike lines get beyond that.
    """
    return compared(celled(rows, BLOCK, "n"), texts, percent)


def compared(cells: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``across`` for rows of cells (key, i, j) with their block."""
    cells = cells.select("key", "i", "j", "block", "node", "component", *NAMES).join(texts, "node")

    def compare(batches):
        for table, group in groups_of(batches, ["key", "i", "j"]):
            x = {c: table.column(c).to_numpy() for c in ("key", "i", "j", "block", "node", "component", *NAMES)}
            lines = pa.concat_arrays(table.column("text").chunks)
            counts = tallies(lines)
            size, counts = counts.sum(axis=1), small(counts)
            tried, held = [], 0
            for a, b in pairs_in(group):
                keep = (x["component"][a] != x["component"][b]) & ((x["i"][a] == x["j"][a]) | (x["block"][a] != x["block"][b]))
                a, b = a[keep], b[keep]
                keep = near(x, a, b, percent)
                a, b = a[keep], b[keep]
                most = np.maximum(size[a], size[b]) * (100 - percent) // 100
                longer = np.abs(size[a] - size[b])
                keep = np.concatenate([least(counts[a[i : i + SLICE]], counts[b[i : i + SLICE]], longer[i : i + SLICE]) for i in range(0, max(1, len(a)), SLICE)]) <= most
                tried.append(np.stack([a[keep], b[keep], most[keep]]))
                held += len(tried[-1][0])
                if held > TRIED:
                    yield close_nodes(x["node"], lines, np.concatenate(tried, axis=1), distance)
                    tried, held = [], 0
            if held:
                yield close_nodes(x["node"], lines, np.concatenate(tried, axis=1), distance)

    return cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(compare, "a long, b long")


def repeated_lines(documents: DataFrame, percent: int = PERCENT, min_bytes: int = MIN_BYTES) -> DataFrame:
    """k1, k2 and ``dropped``, the numbers of a row's lines that repeat an earlier one; rows that keep all lines are left out.

    Earlier means a smaller doc_id, then a smaller row name, then a smaller line number; a null doc_id comes
    first. A row that is there twice is one row, lines of fewer than ``min_bytes`` bytes never go, nor do blank ones.
    Lines are equal if they are so in lower case with white space collapsed; else edit similarity of that form decides.
    """
    rows = keyed(documents)
    lines = written(placed_lines(rows, min_bytes), "lines")
    n_parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), lines.count() * 16 // PART_ENTRIES)
    sent = written(buckets(rows, n_parts, min_bytes, percent), "keys")
    many = sent.where("other IS NULL").select("key", "node", *NAMES, "times", "bounded")
    large, bounded = many.where("NOT bounded").drop("bounded"), many.where("bounded").drop("bounded", "times")
    pairs = sent.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))
    first = written(pairs.union(centred(large, NAMES, fits(percent))).distinct(), "pairs")
    asked = first.select(F.explode(F.array("a", "b")).alias("node")).union(many.select("node")).distinct()
    texts = written(line_texts(rows, lines, asked), "texts")
    groups = linked(first, large, NAMES, fits(percent), lambda pairs: confirmed(pairs, texts, percent), lambda some: across(some, texts, percent))
    one = F.lit(0)
    named = bounded.join(groups, "node", "left") if groups is not None else bounded.withColumn("component", F.lit(None).cast("long"))
    cells = named.withColumns({"component": F.coalesce("component", "node"), "i": one, "j": one, "block": one})
    more = written(compared(cells, texts, percent), "links")
    if not more.isEmpty():
        every = more.union(groups.where("node <> component").select("node", "component")) if groups is not None else more
        joined = written(components(every), "groups")
        if groups is not None:
            dropped(groups)
        groups = joined
    dropped(more)
    placed = lines
    if groups is not None:
        placed = placed.join(groups, "node", "left")
    else:
        placed = placed.withColumn("component", F.lit(None).cast("long"))
    alone = F.when(F.col("component").isNull(), F.col("n"))  # equal names of different lengths stay apart
    placed = placed.select(F.coalesce("component", "node").alias("group"), F.coalesce(alone, F.lit(0)).alias("n"), F.struct("doc_id", "k1", "k2", "line").alias("at"))
    first_of = placed.groupBy("group", "n").agg(F.min("at").alias("first"), F.count("*").alias("times")).where("times > 1").select("group", "n", "first")
    gone = placed.join(first_of, ["group", "n"]).where("at <> first").groupBy("at.k1", "at.k2").agg(F.sort_array(F.collect_set("at.line")).alias("dropped"))
    gone = written(gone, "gone")
    for x in (lines, sent, first, texts, *([groups] if groups is not None else [])):
        dropped(x)
    return gone


def counted(documents: DataFrame, percent: int = PERCENT, min_bytes: int = MIN_BYTES) -> DataFrame:
    """A row per document: doc_id, n_lines, n_dropped and the numbers of the dropped lines, from 0.

    A null text is an empty one, of one line. Very long texts and lines take part whole; equal rows get equal
    results. Other columns of the table don't matter.
    """
    gone = repeated_lines(documents, percent, min_bytes)
    rows = keyed(documents).select("doc_id", "k1", "k2", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
    lost = F.coalesce("dropped", F.array().cast("array<int>"))
    return rows.join(gone, ["k1", "k2"], "left").select("doc_id", "n_lines", F.size(lost).cast("long").alias("n_dropped"), lost.alias("dropped"))


def deduplicated(documents: DataFrame, percent: int = PERCENT, min_bytes: int = MIN_BYTES) -> DataFrame:
    """The documents without repeated lines, all columns kept; a document of which no word is left goes.

    A column n_chars, where there is one, gets the new length. Documents that lost nothing stay as they are,
    null and blank texts included.
    """
    k1, k2, lost = fresh(documents.columns, "k1", "k2", "dropped")
    gone = repeated_lines(documents, percent, min_bytes).toDF(k1, k2, lost)
    held = documents.withColumns(dict(zip((k1, k2), row_keys(documents), strict=True))).join(gone, [k1, k2], "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size(F.split("text", "\n")) - 1), lost)
    left = F.transform(F.array(F.split("text", "\n")), lambda parts: F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n"))[0]
    stays = F.col(lost).isNull()
    held = held.withColumn("text", F.when(stays, F.col("text")).otherwise(left)).where(stays | F.col("text").rlike(r"\S"))
    if "n_chars" in documents.columns:
        held = held.withColumn("n_chars", F.when(stays, F.col("n_chars")).otherwise(F.length("text")).cast(documents.schema["n_chars"].dataType))
    return held.select(*documents.columns)
