"""MinHash near-dedup with fast similarity sketches.

A sketch has t coordinates, filled in rounds: in each of the first t rounds every element of the set falls
into one hashed bin with a value that starts with the number of the round, so early rounds win; in round
t + j all elements meet in bin j. Every coordinate fills, with an element that is as good as the minimum of
an independent hash, after about t log t hashed elements instead of t times the set. Bands of coordinates
become bucket keys, and full shingle sets confirm what buckets suggest.

With bands of 4 of 128 coordinates two sets of similarity 0.75 share no band with a chance of about 5e-6. One
bit of each coordinate comes along: sets of similarity 0.75 differ in 16 of the 128 bits on average, in more
than 36 with a chance below 1e-6, and such pairs are not confirmed further.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import FOLD, SPACES, U, fold_windows, mixed, parts, prefix, spans, words
from .linking import SMALL, celled, centred, groups_of, linked, pairs_in, shared, within
from .rows import fresh, keyed, row_keys
from .scratch import dropped, written

SHINGLE, SIMILAR, COORDINATES, BANDS, MAX_BITS, SLICE = 5, 75, 128, 32, 36, 1 << 20
#: Documents in a block of a cell whose texts are compared in one task.
TEXTS = 512
FULL = U(0xFFFFFFFFFFFFFFFF)


def shingles(column: pa.Array, width: int = SHINGLE, limit: int = SLICE):
    """(first row, end row, row, hash) of slices of a column: each row's distinct shingles, ordered by row and hash."""
    for a, b, data, ends in parts(column, limit):
        data = FOLD[data]
        start, end, row = words(data, ends, SPACES)
        found = spans(prefix(data), start, end)
        counts = np.bincount(row, minlength=b - a)
        rows, hashes = [], []
        if len(row) >= width:
            inside = np.flatnonzero(row[: len(row) - width + 1] == row[width - 1 :])
            rows.append(row[inside])
            hashes.append(fold_windows(found, width)[inside])
        first = np.cumsum(counts) - counts
        for n in range(1, width):  # shorter texts are one shingle
            short = np.flatnonzero(counts == n)
            if len(short):
                rows.append(short)
                hashes.append(mixed(fold_windows(found, n)[first[short]] + U(n)))
        if not rows:
            yield a, b, np.zeros(0, np.int64), np.zeros(0, U)
            continue
        row, found = np.concatenate(rows), np.concatenate(hashes)
        order = np.lexsort((found, row))
        row, found = row[order], found[order]
        new = np.r_[True, (row[1:] != row[:-1]) | (found[1:] != found[:-1])]
        yield a, b, row[new], found[new]


def sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of a whole column's shingles, made in slices."""
    found = [(a + row, hashes) for a, _, row, hashes in shingles(column)]
    return np.concatenate([x[0] for x in found] or [np.zeros(0, np.int64)]), np.concatenate([x[1] for x in found] or [np.zeros(0, U)])


def sketches(row: np.ndarray, found: np.ndarray, n_rows: int, t: int = COORDINATES) -> np.ndarray:
    """Sketch of each row's set; rows with an empty set stay unfilled."""
    out = np.full(n_rows * t, FULL, U)
    for i in range(2 * t):
        x = mixed(found + U((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        place = (x & U(t - 1)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, row * t + place, (U(i) << U(56)) | (x >> U(8)))
        open_ = (out.reshape(n_rows, t) == FULL).any(axis=1)[row]
        row, found = row[open_], found[open_]
        if not len(row):
            break
    return out.reshape(n_rows, t)


def banded(filled: np.ndarray, bands: int = BANDS) -> np.ndarray:
    n, t = filled.shape
    keys = np.zeros((n, bands), U)
    split = filled.reshape(n, bands, t // bands)
    for k in range(t // bands):
        keys = mixed(keys * U(0xD1342543DE82EF95) + split[:, :, k])
    return mixed(keys + np.arange(1, bands + 1, dtype=U) * U(0x9E3779B97F4A7C15))


def sketched(documents: DataFrame) -> DataFrame:
    """doc_id, k1, k2, n_shingles, a 128-bit name of the shingle set, its band keys, and a bit of each coordinate."""
    rows = keyed(documents).select("doc_id", "k1", "k2", "text")
    schema = T.StructType([*rows.schema.fields[:3], *T._parse_datatype_string("n_shingles long, set_a long, set_b long, bands array<long>, bits_a long, bits_b long").fields])

    def sketch(batches):
        for batch in batches:
            sizes, names, others, keys, bits = [], [], [], [], []
            for a, b, row, found in shingles(batch.column(3)):
                n = b - a
                sizes.append(np.bincount(row, minlength=n))
                name, other = np.zeros(n, U), np.zeros(n, U)
                np.add.at(name, row, mixed(found + U(1)))
                np.add.at(other, row, mixed(found + U(2)))
                names.append(name)
                others.append(other)
                filled = sketches(row, found, n)
                keys.append(banded(filled))
                bits.append(np.packbits((mixed(filled) & U(1)).astype(np.uint8), axis=1).view(">i8").astype(np.int64))
            join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, U)
            bands = join(keys).reshape(-1).view(np.int64)
            half = join(bits).astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:3], pa.array(join(sizes).astype(np.int64)), pa.array(join(names).view(np.int64)), pa.array(join(others).view(np.int64)),
                pa.ListArray.from_arrays(pa.array(np.arange(0, len(bands) + 1, BANDS, dtype=np.int32)), pa.array(bands)),
                pa.array(half[:, 0].copy()), pa.array(half[:, 1].copy()),
            ], schema.names)

    return rows.mapInArrow(sketch, schema)


def confirmed(pairs: DataFrame, texts: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have an intersection of ``similar`` hundredths of their union."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def compare(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for lo in range(0, batch.num_rows, 64):
                some = batch.slice(lo, 64)
                n = some.num_rows
                sides = [sets(some.column(i)) for i in (2, 3)]
                sizes = [np.bincount(row, minlength=n) for row, _ in sides]
                row, found = np.concatenate([s[0] for s in sides]), np.concatenate([s[1] for s in sides])
                order = np.lexsort((found, row))
                row, found = row[order], found[order]
                twice = np.flatnonzero((row[1:] == row[:-1]) & (found[1:] == found[:-1]))
                both = np.bincount(row[twice], minlength=n)
                keep[lo : lo + n] = 100 * both >= similar * (sizes[0] + sizes[1] - both)
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long")


def near(x: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, similar: int = SIMILAR) -> np.ndarray:
    """Whether two sets' sizes and bits allow a link."""
    low, high = np.minimum(x["n"][a], x["n"][b]), np.maximum(x["n"][a], x["n"][b])
    apart = sum(np.bitwise_count((x[c][a] ^ x[c][b]).view(U)).astype(np.int64) for c in ("bits_a", "bits_b"))
    return (100 * low >= similar * high) & (apart <= MAX_BITS)


def fits(similar: int) -> str:
    return f"100 * least(s.n, t.n) >= {similar} * greatest(s.n, t.n) AND bit_count(s.bits_a ^ t.bits_a) + bit_count(s.bits_b ^ t.bits_b) <= {MAX_BITS}"


NAMES = ["n", "bits_a", "bits_b"]


def covered(rows: DataFrame, texts: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The rows whose node shares enough shingles with all other nodes together to have a link.

    A link needs an intersection of similar / (100 + similar) of both sizes, and no intersection is larger
    than the part of a set that any other set has too. Counting shingles tells that without pairs.
    """

    def cut(batches):
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            for a, _, row, found in shingles(batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[a + row]), pa.array(found.view(np.int64))], ["node", "shingle"])

    nodes = rows.select("node").distinct()
    each = texts.join(nodes, "node", "left_semi").select("node", "text").mapInArrow(cut, "node long, shingle long")
    common = each.groupBy("shingle").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("shingle")
    counts = each.join(common, "shingle", "left_semi").groupBy("node").agg(F.count("*").alias("shared"))
    return rows.join(counts, "node").where(f"{100 + similar} * shared >= {similar} * (n + ceil(n * {similar} / 100))").drop("shared")


def across(rows: DataFrame, texts: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The links (a, b) between different components of a bucket, on full sets, a cell of two blocks at a time.

    A cell counts the common shingles of all its members at once, as a product of the matrix of members and
    those shingles that several of them have. Only links leave the task.
    """

    def compare(batches):
        for table, group in groups_of(batches, ["key", "i", "j"]):
            x = {c: table.column(c).to_numpy() for c in ("node", "component", "block", "i", "j", *NAMES)}
            asked = []
            for a, b in pairs_in(group):
                keep = (x["component"][a] != x["component"][b]) & ((x["i"][a] == x["j"][a]) | (x["block"][a] != x["block"][b]))
                a, b = a[keep], b[keep]
                keep = near(x, a, b, similar)
                asked.append((a[keep], b[keep]))
            left, right = (np.concatenate(y) for y in zip(*asked, strict=True)) if asked else (np.zeros(0, np.int64),) * 2
            if not len(left):
                continue
            used = np.unique(np.r_[left, right])
            texts_ = table.column("text").combine_chunks().take(pa.array(used))
            row, found = sets(texts_)
            row = used[row]
            edges = np.searchsorted(row, np.arange(table.num_rows + 1))
            out = []
            for g in np.unique(group[left]).tolist():
                mine = group[left] == g
                a, b = left[mine], right[mine]
                members = np.unique(np.r_[a, b])
                lo, hi = edges[members[0]], edges[members[-1] + 1]
                keep = np.isin(row[lo:hi], members)
                own, name = np.searchsorted(members, row[lo:hi][keep]), np.unique(found[lo:hi][keep], return_inverse=True)[1]
                often = np.bincount(name) > 1
                own, name = own[often[name]], (np.cumsum(often) - 1)[name[often[name]]]
                both = np.zeros((len(members), len(members)), np.float32)
                for v in range(0, int(often.sum()), 4096):
                    part = (name >= v) & (name < v + 4096)
                    m = np.zeros((len(members), 4096), np.float32)
                    m[own[part], name[part] - v] = 1
                    both += m @ m.T
                common = both[np.searchsorted(members, a), np.searchsorted(members, b)].astype(np.int64)
                good = 100 * common >= similar * (x["n"][a] + x["n"][b] - common)
                out.append(np.stack([x["node"][a[good]], x["node"][b[good]]], axis=1))
            found_ = np.unique(np.sort(np.concatenate(out), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found_[:, 0].copy()), pa.array(found_[:, 1].copy())], ["a", "b"])

    cells = celled(covered(rows, texts, similar), TEXTS, "n").select("key", "i", "j", "block", "node", "component", *NAMES).join(texts, "node")
    return cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(compare, "a long, b long").distinct()


def _placed(documents: DataFrame, similar: int) -> tuple[DataFrame, list[DataFrame]]:
    """``grouped`` with the names k1 and k2 of each row, and the scratch tables that it reads."""
    rows = written(sketched(documents), "sketches")
    real = rows.where("n_shingles > 0")
    nodes = real.groupBy(F.col("set_a").alias("node")).agg(F.first("n_shingles").alias("n"), *(F.first(x).alias(x) for x in ("bits_a", "bits_b", "bands")), F.count("*").alias("times"))
    met = written(shared(nodes.select("node", "times", *NAMES, F.explode("bands").alias("key"))), "buckets")
    small, large = met.where(f"c <= {SMALL}"), met.where(f"c > {SMALL}").drop("c")
    first = within(small, ["key"], NAMES, lambda x, a, b: near(x, a, b, similar)).union(centred(large, NAMES, fits(similar)))
    first = written(first.distinct(), "pairs")
    asked = first.select(F.col("a").alias("node")).union(first.select("b")).union(large.select("node")).distinct()
    at = real.select(F.col("set_a").alias("node"), "k1", "k2").join(asked, "node", "left_semi").groupBy("node").agg(F.min(F.struct("k1", "k2")).alias("at"))
    k1, k2 = row_keys(documents)
    texts = documents.select("text", k1.alias("k1"), k2.alias("k2")).join(at.select("node", "at.k1", "at.k2"), ["k1", "k2"]).select("node", "text")
    texts = written(texts.dropDuplicates(["node"]), "texts")
    twins = real.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("set_a").alias("a"), F.max("set_a").alias("z"), F.collect_set("set_a").alias("all")).where("a < z").select("a", F.explode("all").alias("b")).where("a < b")
    groups = linked(first, large, NAMES, fits(similar), lambda pairs: confirmed(pairs, texts, similar).union(twins), lambda some: across(some, texts, similar))
    for x in (met, first, texts):
        dropped(x)
    named = rows.select("doc_id", "k1", "k2", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_a")).alias("node"))
    if groups is not None:
        named = named.join(groups, "node", "left").withColumn("node", F.coalesce("component", "node")).drop("component")
    smallest = named.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = named.join(smallest, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    found = named.select("doc_id", "k1", "k2", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
    return found, [rows, *([groups] if groups is not None else [])]


def grouped(documents: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, kept.

    Rows with the same set of shingles are one node from the start, so exact copies never meet in buckets. A text
    without words or a null one is linked with nothing. Rows that share a doc_id are one document: what any of
    their texts links to, all do. A row without doc_id links others, and is kept under no component. Texts of any
    length take part whole; doc_id may be of any type that has an order.
    """
    return _placed(documents, similar)[0].drop("k1", "k2")


def deduplicated(documents: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The kept rows with the columns they had: one document of each group, and one of rows that are equal in doc_id and text.

    Different texts of one kept doc_id all stay, as do rows without doc_id.
    """
    found, scratch = _placed(documents, similar)
    kept = written(found.where("kept").select("k1", "k2").distinct(), "kept")
    for x in scratch:
        dropped(x)
    k1, k2 = fresh(documents.columns, "k1", "k2")
    named = documents.withColumns(dict(zip((k1, k2), row_keys(documents), strict=True))).join(kept.toDF(k1, k2), [k1, k2], "left_semi")
    return named.dropDuplicates([k1, k2]).select(*documents.columns)


#: The same by all shared shingles and transitive closure, for small tables.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
n AS (SELECT doc_id, len(g) AS size FROM s),
x AS (SELECT doc_id, hash(h) AS h FROM (SELECT doc_id, unnest(g) AS h FROM s)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.size + nb.size - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT e.b, r.root FROM r JOIN e ON r.doc_id = e.a)
SELECT n.doc_id, size AS n_shingles, min(root) AS component_id, n.doc_id = min(root) AS kept FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, size
"""
