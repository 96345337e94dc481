"""Two tokenizers aligned by the bytes of the text: overlaps, groups that end together, and counts of linked ids.

Tokens of both sides are laid out along one axis of byte positions a batch, each document after the one before, so
that a sorted as-of merge keyed by document finds for each token's start the other side's token that covers it.
Overlaps of both directions together are all overlaps; where two tokens end at the same byte, a group ends.

Counts of id pairs are summed over the corpus from sums by document. To come back to the documents, the pairs that
hold at least one part in ``HOT`` of all links, of which there can't be more than ``HOT``, are broadcast; every other
pair is rarer than that and is joined by shuffle.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import slices
from .scratch import written
from .token_counts import LONG_RUN, encoder

RANKS_A, FILE_A, FILE_B = "/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
HOT = 1 << 16
SHIFT = 32
#: Ids of either side have fewer bits than this; the rest of 63 numbers the texts of a slice.
ID_BITS = 20
#: Bytes of text that are tokenized and aligned at once; one long text stands alone.
SLICE = 1 << 20


@lru_cache(maxsize=2)
def whole(path: str):
    """The tokenizer of a JSON file; strings of special tokens are plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True
    return out


@lru_cache(maxsize=2)
def pieces_of(ranks: str) -> list[bytes]:
    known = encoder(ranks)
    return [known.decode_single_token_bytes(i) if i < known.n_vocab else b"" for i in range(max(known._mergeable_ranks.values()) + 1)]


@lru_cache(maxsize=2)
def sentence_pieces(path: str):
    """The processor of a model file, and each id's bytes."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if processor.is_byte(i) else piece.replace("▁", " ").encode())
    return processor, out


def encoded_a(text: str, ranks: str, path: str) -> list[int]:
    """Ids of a text by the rank file, which states the vocabulary of the JSON file and is faster; texts with very long white space go by the latter."""
    if LONG_RUN.search(text):
        return whole(path).encode(text, add_special_tokens=False).ids
    return encoder(ranks).encode_ordinary(text)


def covering(starts: np.ndarray, rows: np.ndarray, other_starts: np.ndarray, other_rows: np.ndarray) -> np.ndarray:
    """For each token the number of the other side's token of its document that covers its start."""
    left = pd.DataFrame({"start": starts, "row": rows})
    right = pd.DataFrame({"start": other_starts, "row": other_rows, "other": np.arange(len(other_starts))})
    return pd.merge_asof(left, right, on="start", by="row", direction="backward")["other"].to_numpy(np.int64)


def overlaps(a_start: np.ndarray, a_row: np.ndarray, b_start: np.ndarray, b_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (a, b) of tokens whose bytes overlap, once each, in order."""
    from_a, from_b = covering(a_start, a_row, b_start, b_row), covering(b_start, b_row, a_start, a_row)
    width = max(len(b_start), 1)
    more = np.flatnonzero(a_start[from_b] != b_start)  # where both start together, A's pair is the same
    pairs, further = np.arange(len(a_start)) * width + from_a, from_b[more] * width + more
    pairs = np.insert(pairs, np.searchsorted(pairs, further), further)  # both are in order
    return pairs // width, pairs % width


def _written_out(ids: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decimal ids, each followed by its separator's byte, as one byte array; and where each ends in it."""
    digits = 1 + sum((ids >= 10**k).astype(np.int64) for k in range(1, 7))
    ends = np.cumsum(digits + 1)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[ends - 1] = after
    rest, place, left = ids.astype(np.int64), ends - 2, digits.copy()
    while len(left) and left.any():
        on = left > 0
        out[place[on]] = 48 + rest[on] % 10
        rest, place, left = rest // 10, place - 1, np.maximum(left - 1, 0)
    return out, ends


def aligned(texts: list[str | None], ranks: str = RANKS_A, path_a: str = FILE_A, path_b: str = FILE_B) -> dict[str, list]:
    """Counts, the digest of groups, and the linked ids with how often, for each of some texts."""
    pieces_a, (processor, pieces_b) = pieces_of(ranks), sentence_pieces(path_b)
    all_a, all_b = [], []
    encoded_b = processor.encode([t or "" for t in texts], num_threads=1)
    for text, b in zip(texts, encoded_b, strict=True):
        a = encoded_a(" " + text, ranks, path_a) if text else []
        target = (" " + (text or "")).encode()
        if not text or b"".join(map(pieces_a.__getitem__, a)) != target or b"".join(map(pieces_b.__getitem__, b)) != target:
            a, b = [], []
        all_a.append(a)
        all_b.append(b)

    def laid(all_ids: list[list[int]], pieces: list[bytes]) -> tuple[np.ndarray, ...]:
        counts = np.fromiter(map(len, all_ids), np.int64, len(all_ids))
        ids = np.fromiter(chain.from_iterable(all_ids), np.int64, int(counts.sum()))
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))[ids]
        ends = np.cumsum(sizes)
        return ids, counts, ends - sizes, ends, np.repeat(np.arange(len(counts)), counts)

    a_id, n_a, a_start, a_end, a_row = laid(all_a, pieces_a)
    b_id, n_b, b_start, b_end, b_row = laid(all_b, pieces_b)
    over_a, over_b = overlaps(a_start, a_row, b_start, b_row)
    together = a_end[over_a] == b_end[over_b]
    link_a, link_b = over_a[together], over_b[together]
    n_docs, link_row = len(texts), a_row[link_a]
    links = np.bincount(link_row, minlength=n_docs)
    cuts = a_end[link_a]  # where groups end, in order
    # tokens of both sides in the order of the groups' text: a group's A tokens, then its B tokens
    group_a, group_b = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
    at_a, at_b = np.arange(len(a_id)) + np.searchsorted(group_b, group_a), np.arange(len(b_id)) + np.searchsorted(group_a, group_b, side="right")
    ids, after = np.empty(len(a_id) + len(b_id), np.int64), np.full(len(a_id) + len(b_id), ord(","), np.uint8)
    ids[at_a], ids[at_b] = a_id, b_id
    after[at_a[link_a]], after[at_b[link_b]] = ord("|"), ord(";")
    data, ends = _written_out(ids, after)
    doc_end = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_a + n_b)])]
    linked = np.sort(link_row << 2 * ID_BITS | a_id[link_a] << ID_BITS | b_id[link_b])
    firsts = np.flatnonzero(np.concatenate([[True], linked[1:] != linked[:-1]])) if len(linked) else np.zeros(0, np.int64)
    times, code = np.diff(np.concatenate([firsts, [len(linked)]])), linked[firsts]
    code = np.stack([code >> 2 * ID_BITS, (code >> ID_BITS & (1 << ID_BITS) - 1) << SHIFT | code & (1 << ID_BITS) - 1])
    edges = np.searchsorted(code[0], np.arange(n_docs + 1))
    return {
        "n_a": n_a.tolist(), "n_b": n_b.tolist(), "n_groups": links.tolist(), "n_links": links.tolist(),
        "groups_sha256": [hashlib.sha256(data[s : e - 1].tobytes()).hexdigest() if e > s else "" for s, e in zip(doc_end[:-1].tolist(), doc_end[1:].tolist(), strict=True)],
        "pairs": [code[1, s:e].tolist() for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)],
        "times": [times[s:e].tolist() for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)],
    }


FIELDS = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "pairs": pa.list_(pa.int64()), "times": pa.list_(pa.int32())}
SCHEMA = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def alignments(documents: DataFrame, ranks: str = RANKS_A, path_a: str = FILE_A, path_b: str = FILE_B) -> DataFrame:
    """Per row of the documents: doc_id, counts of tokens, groups and links, the digest of its groups, and its linked id pairs.

    ``pairs`` has A's id above ``SHIFT`` bits and B's below, ``times`` how often each is linked. A text that is null or
    empty, or that one side does not give back byte for byte, has no tokens: zeros, '' and empty arrays. Equal rows
    stand each for itself, other columns don't matter, an empty table gives an empty one. Long texts are tokenized whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for s, e in slices(np.array([len(t or "") for t in texts], np.int64), SLICE):
                found = aligned(texts[s:e], ranks, path_a, path_b)
                yield pa.RecordBatch.from_arrays([ids[s:e], *(pa.array(found[k], t) for k, t in FIELDS.items())], ["doc_id", *FIELDS])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, a_id, b_id, n (links of the corpus) and best (no pair of the same b_id has more links)."""
    links = found.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    b_id = F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1))
    links = links.select("pair", F.shiftright("pair", SHIFT).alias("a_id"), b_id.alias("b_id"), "n")
    most = links.groupBy("b_id").agg(F.max("n").alias("most"))
    return links.join(most, "b_id").select("pair", "a_id", "b_id", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(documents: DataFrame, ranks: str = RANKS_A, path_a: str = FILE_A, path_b: str = FILE_B, hot: int = HOT) -> DataFrame:
    """``alignments`` without the pairs, with n_best (links whose pair is the best of its b_id) and count_sum (over links, their pair's count)."""
    found = alignments(documents, ranks, path_a, path_b)
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "alignments")
    counts = written(pair_counts(found), "pairs")
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * hot >= F.lit(total)  # at most ``hot`` pairs are as frequent
    links = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    figures = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    few = F.broadcast(counts.where(often).select("pair", "n", "best"))
    of_few = links.join(few, "pair").groupBy("row").agg(*figures)
    of_rest = links.join(few.select("pair"), "pair", "left_anti").join(counts.where(~often).select("pair", "n", "best").hint("shuffle_merge"), "pair").groupBy("row").agg(*figures)
    sums = of_few.union(of_rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = found.drop("pairs", "times").join(sums, "row", "left").drop("row")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("n_best", "count_sum")})
