"""Byte-level BPE, encoding and decoding: words by functions of Spark, merges and pieces in numpy.

A token id is written as one character (``character`` below), so that a sequence of tokens is a string, and joining
and counting tokens are string functions.

Words that the vocabulary has whole, and up to ``COMMON`` words that are frequent in the corpus, are encoded once and
looked up; all others stand marked between the tokens and are merged where they stand, all of a batch together, so no
word of a document is ever shuffled back to it. The dictionary is a single row of bounded size, dealt into buckets
because a map of Spark is searched from end to end.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable
from functools import cached_property, lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import fresh
from .scratch import written

#: Code points from here on that UTF-8 can't encode; ids from here on stand this many further.
SURROGATES, JUMP = 0xD800, 0x800
#: Stands before and after the bytes of a word that is to be merged; no token has it, and such a word has characters of one byte.
MARK = "\U0010fffe"
#: No merge. Words of more than LONG bytes are merged one by one, shorter ones TOGETHER at a time.
#: Tasks take ROWS texts at a time.
NONE, LONG, TOGETHER, ROWS = 1 << 30, 64, 4096, 512
COMMON = 1 << 18
WORD_BUCKETS = 131071

#: White space, as the pattern's \\s has it.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Letters and numbers that Unicode added in versions 14 to 16, which a JVM of 17 does not know.
NEW_LETTERS = """870-887 889-88e 8b5 8c8-8c9 c5d cdd 170d 171f 1b4c 1c89-1c8a 2c2f 2c5f 9ffd-9fff a7c0-a7c1 a7cb-a7cd a7d0-a7d1 a7d3
a7d5-a7dc a7f2-a7f4 10570-1057a 1057c-1058a 1058c-10592 10594-10595 10597-105a1 105a3-105b1 105b3-105b9 105bb-105bc 105c0-105f3
10780-10785 10787-107b0 107b2-107ba 10d4a-10d65 10d6f-10d85 10ec2-10ec4 10f70-10f81 11071-11072 11075 1123f-11240 11380-11389 1138b
1138e 11390-113b5 113b7 113d1 113d3 11740-11746 11ab0-11abf 11bc0-11be0 11f02 11f04-11f10 11f12-11f33 12f90-12ff0 1342f 13441-13446
13460-143fa 16100-1611d 16a70-16abe 16d40-16d6c 18cff 1aff0-1aff3 1aff5-1affb 1affd-1affe 1b11f-1b122 1b132 1b155 1df00-1df1e
1df25-1df2a 1e030-1e06d 1e290-1e2ad 1e4d0-1e4eb 1e5d0-1e5ed 1e5f0 1e7e0-1e7e6 1e7e8-1e7eb 1e7ed-1e7ee 1e7f0-1e7fe 2a6de-2a6df
2b735-2b739 2ebf0-2ee5d 31350-323af"""
NEW_NUMBERS = "10d40-10d49 116d0-116e3 11bf0-11bf9 11f50-11f59 16130-16139 16ac0-16ac9 16d70-16d79 1ccf0-1ccf9 1d2c0-1d2d3 1e4f0-1e4f9 1e5f1-1e5fa"
#: Texts of characters below all of these need no more than the JVM's own classes.
PLAIN = "[^\\x00-\\u086f]"


def _class(ranges: str) -> str:
    return "".join("-".join(f"\\x{{{x}}}" for x in r.split("-")) for r in ranges.split())


def pattern(letters: str = "", numbers: str = "") -> str:
    """The public pattern of the byte-level vocabularies for the JVM, each class with further members."""
    letter, number = f"\\p{{L}}{letters}", f"\\p{{N}}{numbers}"
    return f"'(?:[stmd]|re|ve|ll)| ?[{letter}]++| ?[{number}]++| ?[^{letter}{number}{WHITE}]++|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"


def words_of(text: Column) -> Column:
    """Array of the pattern's matches, which together are the text."""

    def split(p: str) -> Column:
        return F.regexp_extract_all(text, F.lit(p), F.lit(0))

    return F.when(F.regexp_like(text, F.lit(PLAIN)), split(pattern(_class(NEW_LETTERS), _class(NEW_NUMBERS)))).otherwise(split(pattern()))


def character(token: int) -> str:
    return chr(token if token < SURROGATES else token + JUMP)


@lru_cache(maxsize=2)
def tokens_of(vocabulary: str) -> dict[bytes, int]:
    with open(vocabulary, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often the body has it."""
    return F.element_at(F.transform(F.array(value), body), 1)


class Merges:
    """What neighbouring tokens merge to, in sorted arrays of bounded size."""

    def __init__(self, tokens: dict[bytes, int]):
        found = {}
        for token, rank in tokens.items():
            for k in range(1, len(token)):
                x, y = tokens.get(token[:k]), tokens.get(token[k:])
                if x is not None and y is not None:
                    found[x << 32 | y] = rank
        self.keys = np.array(sorted(found), np.int64)
        self.ranks = np.array([found[k] for k in self.keys.tolist()] + [NONE], np.int64)
        self.bytes = np.array([tokens[bytes([b])] for b in range(256)], np.int64)

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The tokens that pairs merge to, NONE where they don't; -1 stands for no token."""
        key = (x << 32) + y
        at = np.searchsorted(self.keys, key)
        return np.where(np.r_[self.keys, -NONE][at] == key, self.ranks[at], NONE)

    def folded(self, words: list[bytes]) -> np.ndarray:
        """A row of tokens for each word, filled up by -1: one merge of each word at a time, lowest rank and then leftmost first."""
        size = np.array([len(w) for w in words])
        tokens = np.full((len(words), int(size.max()) + 1), -1, np.int64)
        place = np.arange(tokens.shape[1])
        tokens[place < size[:, None]] = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        out, row, t = tokens, np.arange(len(words)), tokens
        ranks = np.full(t.shape, NONE, np.int64)
        ranks[:, :-1] = self.of(t[:, :-1], t[:, 1:])
        while True:
            at = ranks.argmin(axis=1)
            low = ranks[np.arange(len(row)), at]
            on = low < NONE
            out[row[~on], : t.shape[1]] = t[~on]
            if not on.any():
                return out
            row, t, ranks, at, low = row[on], t[on], ranks[on], at[on], low[on]
            each = np.arange(len(row))
            t[each, at] = low
            after = np.minimum(place + (place > at[:, None]), len(place) - 1)
            t, ranks = np.take_along_axis(t, after, 1), np.take_along_axis(ranks, after, 1)
            ranks[each, at] = self.of(low, t[each, at + 1])
            left = np.flatnonzero(at)
            ranks[left, at[left] - 1] = self.of(t[left, at[left] - 1], low[left])

    def folded_long(self, word: bytes) -> np.ndarray:
        """The tokens of one word, in time that follows its bytes: a heap of merges over linked places."""
        tokens = self.bytes[np.frombuffer(word, np.uint8)]
        n = len(tokens)
        ranks = self.of(tokens[:-1], tokens[1:])
        heap = [*((ranks << 32) + np.arange(n - 1))[ranks < NONE].tolist()]
        heapify(heap)
        t, before, after = array("q", tokens.tolist()), array("q", range(-1, n - 1)), array("q", range(1, n + 1))
        merges = self.named if heap else {}
        while heap:
            rank, at = divmod(heappop(heap), 1 << 32)
            if t[at] < 0 or after[at] >= n or merges.get(t[at] << 32 | t[after[at]]) != rank:
                continue  # one of the two has merged since
            gone = after[at]
            t[at], t[gone], after[at] = rank, -1, after[gone]
            if after[at] < n:
                before[after[at]] = at
                if (x := merges.get(rank << 32 | t[after[at]])) is not None:
                    heappush(heap, x << 32 | at)
            if before[at] >= 0 and (x := merges.get(t[before[at]] << 32 | rank)) is not None:
                heappush(heap, x << 32 | before[at])
        tokens = np.frombuffer(t, np.int64)
        return tokens[tokens >= 0]

    @cached_property
    def named(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.ranks.tolist()))

    def strings(self, words: list[bytes]) -> list[str]:
        """The token string of each word."""
        out = [""] * len(words)
        order = sorted((i for i, w in enumerate(words) if len(w) <= LONG), key=lambda i: len(words[i]))
        for a in range(0, len(order), TOGETHER):
            some = order[a : a + TOGETHER]
            tokens = self.folded([words[i] for i in some])
            text = _characters(tokens[tokens >= 0])
            ends = np.cumsum((tokens >= 0).sum(axis=1)).tolist()
            for i, x, y in zip(some, [0, *ends], ends):
                out[i] = text[x:y]
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = _characters(self.folded_long(w))
        return out


def _characters(tokens: np.ndarray) -> str:
    return (tokens + JUMP * (tokens >= SURROGATES)).astype("<u4").tobytes().decode("utf-32-le")


def _tokens(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    return codes - JUMP * (codes >= SURROGATES)


def _bytes_of(texts: list[str | None], data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The pieces of each token string, one after another."""
    out = []
    for text in texts:
        ids = _tokens(text or "")
        size = ends[ids + 1] - ends[ids]
        last = np.cumsum(size)
        place = np.repeat(ends[ids] - last + size, size) + np.arange(last[-1] if len(last) else 0)
        out.append(None if text is None else data[place].tobytes())
    return pa.array(out, pa.binary())


class Codec:
    """Encoder and decoder of one rank file. ``vocabulary`` is read by the driver alone."""

    def __init__(self, spark: SparkSession, vocabulary: str):
        self.spark, self._tokens = spark, tokens_of(vocabulary)
        self.size = max(self._tokens.values()) + 1
        assert self.size + JUMP < ord(MARK)
        pieces = [b""] * self.size
        for token, rank in self._tokens.items():
            pieces[rank] = token
        self._merges = Merges(self._tokens)
        share = spark.sparkContext.broadcast
        self._shared_merges = share(self._merges)  # a few megabytes each
        self._shared_pieces = share((np.frombuffer(b"".join(pieces), np.uint8), np.r_[0, np.cumsum([len(x) for x in pieces])]))
        whole = [(w, character(rank)) for token, rank in self._tokens.items() if (w := token.decode("utf-8", "ignore")).encode() == token]
        self._whole = written(spark.createDataFrame(pa.table({"word": [w for w, _ in whole], "tokens": [c for _, c in whole]})), "vocabulary")
        self.dictionary: Column | None = None

    @property
    def _pairs(self) -> Column:
        """The merges as one value for expressions, from a scratch table: as a literal it would stand in every plan."""
        x, y = np.divmod(self._merges.keys, 1 << 32)
        row = pa.array([[{"x": a, "y": b, "rank": c} for a, b, c in zip(x.tolist(), y.tolist(), self._merges.ranks.tolist())]])
        return written(self.spark.createDataFrame(pa.table({"x": row})), "pairs").scalar()

    def _marked(self, word: Column) -> Column:
        return F.concat(F.lit(MARK), F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), F.lit(MARK))

    def _settled(self, marked: DataFrame, name: str, back: str | None = None) -> DataFrame:
        """The rows with each marked word of a column merged, equal words of some rows once; ``back`` names a column for what it decodes to."""
        at, merges, pieces = marked.columns.index(name), self._shared_merges, self._shared_pieces
        schema = T.StructType([*marked.schema.fields, *([T.StructField(back, T.BinaryType())] if back else [])])

        def merge(batches):
            for whole in batches:
                for batch in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
                    parts = [None if x is None else x.split(MARK) for x in batch.column(at).to_pylist()]
                    where = {w: i for i, w in enumerate(dict.fromkeys(w for p in parts if p for w in p[1::2]))}
                    made = merges.value.strings([w.encode("latin-1") for w in where])
                    for p in parts:
                        if p:
                            p[1::2] = [made[where[w]] for w in p[1::2]]
                    texts = [None if p is None else "".join(p) for p in parts]
                    cols = [*batch.columns]
                    cols[at] = pa.array(texts, batch.schema.field(at).type)
                    yield pa.RecordBatch.from_arrays([*cols, *([_bytes_of(texts, *pieces.value)] if back else [])], schema.names)

        return marked.mapInArrow(merge, schema)

    def learned(self, documents: DataFrame, text: str = "text", common: int = COMMON) -> Codec:
        """Fill the dictionary: the vocabulary's own words, and frequent words of the documents, each encoded once.

        Frequency is counted over all texts; the words taken are those at or above a count that at most ``common``
        words reach, in steps of an eighth of a power of two. A codec without it can't encode.
        """
        step = F.floor(F.log2(F.col("n")) * 8)
        counts = documents.select(F.explode(words_of(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where("n > 1")
        counts = written(counts.join(F.broadcast(self._whole.select("word")), "word", "left_anti").select("word", step.alias("step")), "words")
        total, least = 0, 1 << 30
        for at, n in sorted(map(tuple, counts.groupBy("step").count().collect()), reverse=True):  # a few hundred steps
            total += n
            if total > common:
                break
            least = at
        found = self._settled(counts.where(F.col("step") >= least).select("word", self._marked(F.col("word")).alias("tokens")), "tokens").union(self._whole)
        dealt = found.groupBy(F.pmod(F.hash("word"), F.lit(WORD_BUCKETS)).alias("bucket")).agg(F.collect_list(F.struct("word", "tokens")).alias("entries"))
        every = self.spark.range(WORD_BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(dealt, "bucket", "left")
        row = every.agg(F.sort_array(F.collect_list(F.struct("bucket", F.coalesce("entries", F.expr("cast(array() AS array<struct<word: string, tokens: string>>)")).alias("entries")))).alias("x"))
        self.dictionary = written(row.select(F.transform("x", lambda b: F.map_from_entries(b["entries"])).alias("x")), "dictionary").scalar()
        return self

    def encoded(self, documents: DataFrame, text: Column, name: str, keep: list[str] | None = None, back: str | None = None) -> DataFrame:
        """The documents and the token strings of a text; each match of the pattern is encoded by itself. Null stays null.

        Of the documents the columns ``keep`` stay, or all; ``back`` names a column for the bytes that the tokens decode to.
        The dictionary comes in as a column that one expression reads, which the optimizer folds into it: no row carries it.
        """
        assert self.dictionary is not None, "learn the dictionary first"

        def word(known: Column, w: Column) -> Column:
            return F.coalesce(F.element_at(F.get(known, F.pmod(F.hash(w), F.lit(WORD_BUCKETS))), w), self._marked(w))

        (k,) = fresh(documents.columns, "known")
        tokens = let(F.col(k), lambda known: F.array_join(F.transform(words_of(text), lambda w: word(known, w)), ""))
        return self._settled(documents.select("*", self.dictionary.alias(k)).select(*(documents.columns if keep is None else keep), tokens.alias(name)), name, back)

    def ids(self, tokens: Column) -> Column:
        """Array of token ids of a token string."""
        of = lambda c: F.ascii(c) - F.when(F.ascii(c) >= SURROGATES, F.lit(JUMP)).otherwise(F.lit(0))
        return F.when(tokens == "", F.expr("cast(array() AS array<int>)")).otherwise(F.transform(F.split(tokens, ""), of))

    def decoded(self, documents: DataFrame, tokens: str, name: str) -> DataFrame:
        """The documents and the bytes of a column of token strings: the tokens' pieces, one after another."""
        at, shared = documents.columns.index(tokens), self._shared_pieces
        schema = T.StructType([*documents.schema.fields, T.StructField(name, T.BinaryType())])

        def decode(batches):
            for whole in batches:
                for batch in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
                    yield pa.RecordBatch.from_arrays([*batch.columns, _bytes_of(batch.column(at).to_pylist(), *shared.value)], schema.names)

        return documents.mapInArrow(decode, schema)

    def packed(self, tokens: Column) -> Column:
        """The ids as little-endian unsigned 32-bit integers.

        As long as no id stands beyond the surrogates, the string's UTF-32 has the ids; it is big-endian, so the
        string goes in backwards and its bytes are turned round.
        """
        if self.size <= SURROGATES:
            return F.encode(F.reverse(F.decode(F.encode(F.reverse(tokens), "UTF-32"), "ISO-8859-1")), "ISO-8859-1")
        turned = lambda x: F.regexp_replace(F.lpad(F.hex(x), 8, "0"), "(..)(..)(..)(..)", "$4$3$2$1")
        return F.unhex(F.array_join(F.transform(self.ids(tokens), turned), ""))


def encoded(documents: DataFrame, vocabulary: str, text: str = "text", common: int = COMMON) -> tuple[DataFrame, Codec, str]:
    """The documents with a column of token strings, the codec that reads them, and the column's name.

    Every row is encoded whole, repeated ones too; an empty or null text has an empty token string, and other columns
    stay as they are (the new one is ``tokens``, with underscores where that is taken). An empty table stays empty. A
    text is held in memory with its words; a word of many bytes takes time by its bytes and its different merges.
    """
    codec = Codec(documents.sparkSession, vocabulary).learned(documents, text, common)
    (name,) = fresh(documents.columns, "tokens")
    return codec.encoded(documents, F.coalesce(F.col(text), F.lit("")), name), codec, name


def digests(documents: DataFrame, vocabulary: str) -> DataFrame:
    """Per document: n_tokens, and digests of its ids and of what they decode to."""
    codec = Codec(documents.sparkSession, vocabulary).learned(documents)
    found = codec.encoded(documents.select("doc_id", "text"), F.coalesce("text", F.lit("")), "tokens", ["doc_id"], "decoded")
    tokens = F.col("tokens")
    return found.select("doc_id", F.length(tokens).cast("long").alias("n_tokens"), F.sha2(codec.packed(tokens), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
