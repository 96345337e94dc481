"""Spelling variants: words one edit apart, found by probing their generated edits against Bloom filters.

The vocabulary (frequent words of the corpus) goes into blocked Bloom filters, one stretch of blocks per word length:
a word's hash names one block of 64 bits of its length's stretch and ``BITS`` bits in it. Words hash by a table over
(position, character), so the hash of every edit follows from its word's in one step. Only deletions and
replacements by a greater character are probed, which meets each pair of words once: an insertion is the other
word's deletion. What passes the filter is joined with the vocabulary, which removes false positives, and mirrored.

Filters are broadcast and hold at most ``PASS_BYTES`` at once; a larger vocabulary is probed in several passes, each
over the words whose hash falls to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import mixed
from .scratch import dropped, written

#: Runs of these are words; only A-Z are lower-cased. All are single bytes of Latin-1.
RUNS = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALPHABET = np.array([*range(97, 123), *range(0xC0, 0x100)], np.uint8)
DAMAGE = 199
MIN_LENGTH, MIN_COUNT, FACTOR = 6, 5, 5
BITS, BITS_PER_WORD = 6, 24
PASS_BYTES = 1 << 25
#: Words longer than this hash by position modulo it, which is still the same for a word and its probed edits.
POSITIONS = 256
TABLE = np.random.default_rng(20240313).integers(0, 1 << 64, (POSITIONS, 256), dtype=np.uint64)
#: Edits that are tried at once.
PROBES = 1 << 20


def words_of(documents: DataFrame) -> DataFrame:
    """A row ``word`` for each run of at least MIN_LENGTH letters, some with a letter lost: those that a checksum of doc_id and run picks.

    A null doc_id counts as an empty one.
    """
    runs = F.filter(F.regexp_extract_all("text", F.lit(RUNS), F.lit(0)), lambda x: F.length(x) >= MIN_LENGTH)
    rows = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")).withColumn("run", F.translate("run", UPPER, LOWER))
    rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    lost = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return rows.select(F.when(F.col("h") % DAMAGE == 0, lost).otherwise(F.col("run")).alias("word")).where(F.length("word") >= MIN_LENGTH)


def vocabulary(documents: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words that occur at least so often."""
    return words_of(documents).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def matrices(words: list[str]) -> Iterator[np.ndarray]:
    """Words of equal length as rows of Latin-1 bytes, a bounded number of edits at once."""
    by_length: dict[int, list[bytes]] = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w.encode("latin-1"))
    for length, group in by_length.items():
        step = max(1, PROBES // (length * len(ALPHABET)))
        for i in range(0, len(group), step):
            part = group[i : i + step]
            yield np.frombuffer(b"".join(part), np.uint8).reshape(len(part), length)


def _terms(chars: np.ndarray, shift: int = 0) -> np.ndarray:
    """Each character's share of the hash, at its own place or ``shift`` places before it."""
    return TABLE[(np.arange(chars.shape[1]) - shift) % POSITIONS, chars]


def hashes(chars: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.reduce(_terms(chars), axis=1) if chars.shape[1] else np.zeros(len(chars), np.uint64)


def places(raw: np.ndarray, blocks: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block within the length's stretch, and the bits in it, of raw hashes."""
    h = mixed(raw)
    bits = np.zeros(h.shape, np.uint64)
    for k in range(BITS):
        bits |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return (mixed(h ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(blocks)).astype(np.int64), bits


def pass_of(raw: np.ndarray, passes: int) -> np.ndarray:
    return mixed(raw + np.uint64(0x2545F4914F6CDD1D)) % np.uint64(passes)


class Filters:
    """Blocks of all lengths in one array; each length has a stretch of it."""

    def __init__(self, sizes: dict[int, int]):
        self.blocks = {length: max(1, -(-n * BITS_PER_WORD // 64)) for length, n in sizes.items()}
        starts = np.concatenate([[0], np.cumsum(list(self.blocks.values()))]).astype(np.int64)
        self.start, self.data = dict(zip(self.blocks, starts.tolist(), strict=False)), np.zeros(int(starts[-1]), np.uint64)

    def hit(self, raw: np.ndarray, length: int) -> np.ndarray:
        if length not in self.blocks:
            return np.zeros(raw.shape, bool)
        block, bits = places(raw, self.blocks[length])
        return self.data[self.start[length] + block] & bits == bits


def filled(words: DataFrame, sizes: dict[int, int], number: int, passes: int) -> Filters:
    """Filters of a pass. Bits of a block are put together by Spark; the driver gets one row a block at most, of a bounded number."""
    out = Filters(sizes)
    blocks, start = out.blocks, out.start

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chars in matrices(batch.column(0).to_pylist()):
                raw = hashes(chars)
                raw = raw[pass_of(raw, passes) == number]
                block, mask = places(raw, blocks[chars.shape[1]])
                yield pa.RecordBatch.from_arrays([pa.array(start[chars.shape[1]] + block), pa.array(mask.view(np.int64))], ["block", "bits"])

    found = words.select("word").mapInArrow(bits, "block long, bits long").groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()
    out.data[found["block"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def edits(chars: np.ndarray, known: Filters, number: int, passes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, edit as bytes) of all deletions and greater replacements of words of one length that pass the filters."""
    n, length = chars.shape
    own, shifted = _terms(chars), _terms(chars, 1)
    before = np.zeros((n, length + 1), np.uint64)
    after = np.zeros((n, length + 1), np.uint64)
    before[:, 1:] = np.bitwise_xor.accumulate(own, axis=1)
    after[:, :-1] = np.bitwise_xor.accumulate(shifted[:, ::-1], axis=1)[:, ::-1]
    # of a run of equal characters one deletion stands for all
    raw = before[:, :-1] ^ after[:, 1:]
    fresh = np.ones((n, length), bool)
    fresh[:, 1:] = chars[:, 1:] != chars[:, :-1]
    fresh &= pass_of(raw, passes) == number
    row, at = np.nonzero(fresh & known.hit(raw, length - 1))
    if len(row):
        keep = np.arange(length - 1) + (np.arange(length - 1) >= at[:, None])
        yield row, chars[row[:, None], keep]
    whole = before[:, -1]
    for i in range(length):
        raw = (whole ^ own[:, i])[:, None] ^ TABLE[i % POSITIONS, ALPHABET][None, :]
        greater = ALPHABET[None, :] > chars[:, i][:, None]
        greater &= pass_of(raw, passes) == number
        row, which = np.nonzero(greater)
        passed = known.hit(raw[row, which], length)
        row, which = row[passed], which[passed]
        if len(row):
            changed = chars[row].copy()
            changed[:, i] = ALPHABET[which]
            yield row, changed


def candidates(words: DataFrame, known: Filters, number: int = 0, passes: int = 1) -> DataFrame:
    """(word, edit): edits of words of the vocabulary that pass the filters."""
    shared = words.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chars in matrices(batch.column(0).to_pylist()):
                names = [bytes(x).decode("latin-1") for x in chars]
                for row, changed in edits(chars, shared.value, number, passes):
                    found = [bytes(x).decode("latin-1") for x in changed]
                    yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in row.tolist()]), pa.array(found)], ["word", "edit"])

    return words.select("word").mapInArrow(run, "word string, edit string")


def near_pairs(words: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(word, n, near, near_n) of all words one edit apart, both ways round. ``words`` is a written table of (word, n)."""
    sizes = {r[0]: r[1] for r in words.groupBy(F.length("word")).count().collect()}  # one row a length
    passes = max(1, -(-sum(sizes.values()) * BITS_PER_WORD // (8 * pass_bytes)))
    shares = {length: -(-n // passes) for length, n in sizes.items()}
    dealt = words.repartition(max(1, min(10_000, sum(sizes.values()) // 20_000)), "word")
    found = None
    for number in range(passes):
        one = candidates(dealt, filled(words, shares, number, passes), number, passes)
        one = written(one, "edits") if passes > 1 else one  # a pass's filters are needed no longer
        found = one if found is None else found.union(one)
    if found is None:
        found = words.select("word", F.col("word").alias("edit")).limit(0)
    pairs = found.join(words.select(F.col("word").alias("edit"), F.col("n").alias("near_n")), "edit").join(words, "word").select("word", "n", F.col("edit").alias("near"), "near_n")
    return pairs.select(F.explode(F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))).alias("x")).select("x.*")


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms are followed to the last, twice as far with each turn.

    A form has five times its word's count at least, so a chain is no longer than the logarithm of the largest count
    and has no circle. Only words that have a form take part.
    """
    known = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = known.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = written(step, "roots")
        moved = step.where("moved").limit(1).count()
        dropped(known)
        known = step.select("word", "root")
        known._scratch_path = step._scratch_path
        if not moved:
            return known


def grouped(documents: DataFrame, min_count: int = MIN_COUNT, factor: int = FACTOR, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """One row per frequent word: its nearest frequent form, the root that forms lead to, and its number of near words.

    ``form`` is the near word of the largest count (ties: the smallest), where that is at least ``factor`` times the
    word's; ``root`` is the word itself where it has no form. Null and empty texts have no words, long texts are read
    whole, repeated rows count each, and columns beside doc_id and text don't matter. No frequent word, no row.
    """
    words = written(vocabulary(documents, min_count), "words")
    near = near_pairs(words, pass_bytes).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near").alias("form"))).alias("first"))
    named = words.join(near, "word", "left")
    form_n = -F.col("first.rank")
    found = written(
        named.select(
            "word", F.when(form_n >= factor * F.col("n"), F.col("first.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(form_n >= factor * F.col("n"), form_n).cast("long").alias("form_n"),
        ), "variants",
    )
    roots = rooted(found.where("form IS NOT NULL").select("word", "form"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: CRC-32 by its rule: the table of bytes first, then a fold over the bytes of each name.
ORACLE = """
WITH RECURSIVE bits(b, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i) UNION ALL
  SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+')) AS r FROM documents) WHERE length(r) >= 6
), named AS (SELECT w, coalesce(doc_id::VARCHAR, '') || ':' || w AS name, count(*) AS k FROM runs GROUP BY ALL),
hexed AS (SELECT w, k, hex(encode(name)) AS x, t FROM named, crc),
hashed AS (
  SELECT w, k, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, length(x) + 1, 2), lambda i: (16 * (instr('0123456789ABCDEF', x[i]) - 1) + instr('0123456789ABCDEF', x[i + 1]) - 1)::BIGINT)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS h FROM hexed
), words AS (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT k, CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word FROM hashed
  ) WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5
), cut AS (
  SELECT DISTINCT word, n, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS short FROM words, range(1, length(word) + 1) t(i)
), holed AS (
  SELECT word, n, substr(word, 1, i::INT - 1) || '_' || substr(word, i::INT + 1) AS hole FROM words, range(1, length(word) + 1) t(i)
), pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM holed a JOIN holed b ON a.hole = b.hole AND a.word <> b.word UNION ALL
  SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.short = b.word UNION ALL
  SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.short = b.word
), near AS (
  SELECT word, count(*) AS n_near, max(near_n) AS most, min(near) FILTER (near_n = top) AS first
  FROM (SELECT *, max(near_n) OVER (PARTITION BY word) AS top FROM pairs) GROUP BY word
), forms AS (
  SELECT w.word, CASE WHEN most >= 5 * w.n THEN first END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * w.n THEN most END AS form_n
  FROM words w LEFT JOIN near USING (word)
), chain(word, root, depth) AS (
  SELECT word, word, 0 FROM forms UNION ALL SELECT c.word, f.form, depth + 1 FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN (SELECT word, arg_max(root, depth) AS root FROM chain GROUP BY word) c USING (word)
"""
