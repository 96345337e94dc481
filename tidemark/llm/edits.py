"""Exact edit distance of two texts by bit vectors (Myers): a column of the table is one long integer."""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa

BINS = 32


def tallies(texts: pa.Array) -> np.ndarray:
    """A row per text: how many of its characters fall into each of BINS classes, by the first byte of each."""
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    row = np.repeat(np.arange(len(texts)), np.diff(ends))
    first = (data & 0xC0) != 0x80
    return np.bincount(row[first] * BINS + (data[first] & (BINS - 1)), minlength=len(texts) * BINS).reshape(len(texts), BINS).astype(np.int32)


def least(a: np.ndarray, b: np.ndarray, longer: np.ndarray | None = None) -> np.ndarray:
    """A bound from below for the edit distance of the texts of each two tallies: an edit takes one character away and brings one.

    That is half of all differences and of what one text is ``longer``; small tallies may stand for greater ones.
    """
    more = a - b
    if longer is None:
        longer = np.abs(more.sum(axis=1))
    return (added(np.abs(more, out=more)) + longer) >> 1


#: Sums of BINS numbers up to this fit 16 bits.
MOST = (1 << 15) // BINS - 1


def small(counts: np.ndarray) -> np.ndarray:
    return np.minimum(counts, MOST).astype(np.int16)


def added(x: np.ndarray) -> np.ndarray:
    """Sums of rows of BINS numbers, by halves, as whole columns."""
    width = x.shape[1]
    while width > 1:
        width //= 2
        x = x[:, :width] + x[:, width:]
    return x[:, 0].astype(np.int64)


#: From so many characters on, runs of three are counted (in GRAMS classes) before texts are compared.
LONG, GRAMS = 48, 1024


def grams(text: str) -> np.ndarray:
    """How many runs of three characters fall into each of GRAMS classes."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount((x[:-2] * np.uint32(961) + x[1:-1] * np.uint32(31) + x[2:]) % np.uint32(GRAMS), minlength=GRAMS)


def apart(a: str, b: str) -> int:
    """A bound from below for the edit distance: an edit takes three runs of three characters away and brings three at most."""
    return -(-int(np.abs(grams(a) - grams(b)).sum()) // 6)


def aligned(a: str, b: str, most: int) -> int:
    """A bound from above for the edit distance, by words in order; where words differ it goes on at the next pair of words that agree."""
    x, y = a.split(" "), b.split(" ")
    i = j = cost = 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        p, q = next(((p, q) for p, q in AHEAD if x[i + p : i + p + 1] == y[j + q : j + q + 1] != []), (1, 1))
        cost += max(sum(map(len, x[i : i + p])) + p, sum(map(len, y[j : j + q])) + q) if p != q else max(len(" ".join(x[i : i + p])), len(" ".join(y[j : j + q])))
        i, j = i + p, j + q
        if cost > most:
            return cost
    return cost + sum(len(w) + 1 for w in x[i:]) + sum(len(w) + 1 for w in y[j:])


#: Words to pass over on either side, the fewest first.
AHEAD = sorted(((p, q) for p in range(4) for q in range(4) if p or q), key=lambda x: (sum(x), abs(x[0] - x[1])))


def distance(a: str, b: str, most: int | None = None) -> int:
    """Edit distance; where it exceeds ``most``, any number above that, and below ``most`` one that is at least the distance.

    Common start and end are cut off first; of long texts, bounds may tell already on which side of ``most`` they are.
    """
    n = len(os.path.commonprefix((a, b)))
    a, b = a[n:], b[n:]
    n = len(os.path.commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - n], b[: len(b) - n]
    if not a or not b:
        return len(a) + len(b)
    if most is not None and min(len(a), len(b)) >= LONG:
        if (bound := aligned(a, b, most)) <= most:
            return bound
        if (bound := apart(a, b)) > most:
            return bound
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = full, 0, len(a)
    most = len(a) + len(b) if most is None else most
    for left, c in zip(range(len(b) - 1, -1, -1), b):
        same = where.get(c, 0)
        down = same | minus
        across = (((same & plus) + plus) ^ plus) | same
        up = minus | (full & ~(across | plus))
        less = plus & across
        if up & last:
            score += 1
        elif less & last:
            score -= 1
        if score - left > most:  # each letter that is left takes one off at most
            return score
        up = up << 1 | 1
        plus, minus = (less << 1 | ~(down | up)) & full, up & down & full
        if not left & 15 and left < len(a):  # what it costs to get to the last diagonal, which never falls along it
            upto = (1 << (len(a) - left)) - 1
            reached = len(b) - left + (plus & upto).bit_count() - (minus & upto).bit_count()
            if reached > most:
                return reached
    return score


#: Fewer pairs than FEW are compared one by one; others a batch of BATCH together, COLUMNS of their tables between two
#: looks at which of them may still do, in bands of up to WORDS times 64 diagonals. A wider band needs ``distance``.
FEW, BATCH, COLUMNS, WORDS = 16, 1024, 32, 4


def codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All characters of a column as numbers from 2 on, in the narrowest type that holds them, and where each text ends."""
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    wide = (data >= 0x80).any()
    if wide:
        ends = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][ends]
        data = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    most = int(data.max(initial=0)) + 2
    return data.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32) + 2, ends


def close(texts: pa.Array, a: np.ndarray, b: np.ndarray, most: np.ndarray, one: Callable[[str, str, int], int] = distance) -> np.ndarray:
    """Whether the edit distance of texts ``a[i]`` and ``b[i]`` is ``most[i]`` or less: exact, many pairs at a time.

    ``one`` compares the pairs that are too few or too long for that. A column of a table is a band of diagonals about the first and the last one, a bit each (Hyyrö's form of Myers' vectors).
    """
    if not len(a):
        return np.zeros(0, bool)
    data, ends = codes(texts)
    length = np.diff(ends)
    a, b = np.where(length[a] >= length[b], a, b), np.where(length[a] >= length[b], b, a)
    out = length[a] - length[b] <= most
    if len(a) < FEW:
        for i in np.flatnonzero(out).tolist():
            out[i] = one(texts[int(a[i])].as_py(), texts[int(b[i])].as_py(), int(most[i])) <= most[i]
        return out
    band = np.where(out, most // 64 + 1, 0)
    for words in range(1, int(band.max(initial=0)) + 1):
        mine = np.flatnonzero(band == words)
        if words > WORDS or len(mine) < FEW:
            for i in mine.tolist():
                out[i] = one(texts[int(a[i])].as_py(), texts[int(b[i])].as_py(), int(most[i])) <= most[i]
            continue
        mine = mine[np.argsort(length[b[mine]], kind="stable")]
        for at in range(0, len(mine), BATCH):
            some = mine[at : at + BATCH]
            out[some] = banded(data, ends, a[some], b[some], most[some], words)
    return out


def banded(data: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, words: int) -> np.ndarray:
    """``close`` for pairs of a longer and a shorter text whose limits are below ``64 * words``.

    Both texts of a pair are filled up with the same characters to the columns of the batch, which leaves their distance.
    """
    width, n = 64 * words, len(a)
    size, other = (ends[x + 1] - ends[x] for x in (a, b))
    columns = max(1, int(other.max(initial=0)))
    more = size - other
    low = more + (most - more) // 2  # the lowest diagonal of the band
    rows = laid(data, ends[a], size, width - 1 - low, columns + width)
    chars = laid(data, ends[b], other, np.zeros(n, np.int64), columns)
    bits = np.arange(width)
    plus = packed_bits(bits >= (width - 1 - low)[:, None])
    upto = packed_bits((bits >= (width - 1 - low + more)[:, None]) & (bits < width - 1))
    minus, score, out = np.zeros_like(plus), low.copy(), np.zeros(n, bool)
    left = np.arange(n)
    for at in range(0, columns, COLUMNS):
        to = min(columns, at + COLUMNS)
        windows = np.lib.stride_tricks.sliding_window_view(rows[:, at : to + width - 1], width, axis=1)
        same = np.packbits(windows == chars[:, at:to, None], axis=-1, bitorder="little").view("<u8")
        same = np.ascontiguousarray(same.transpose(1, 2, 0))
        for x in same:
            plus, minus, kept = column(x, plus, minus)
            score += 1 - kept
        reached = score - np.bitwise_count(plus & upto).sum(axis=0, dtype=np.int64) + np.bitwise_count(minus & upto).sum(axis=0, dtype=np.int64)
        keep = np.flatnonzero(reached <= most)  # costs never fall along a diagonal, so not along the last one
        if to == columns:
            out[left[keep]] = True
        elif len(keep) < len(left):
            rows, chars, score, most, left = rows[keep], chars[keep], score[keep], most[keep], left[keep]
            plus, minus, upto = (np.ascontiguousarray(x[:, keep]) for x in (plus, minus, upto))
            if not len(left):
                break
    return out


def column(same: np.ndarray, plus: np.ndarray, minus: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a column adds and takes off from row to row, one row further down, and whether the lowest row costs no more than before."""
    total = same & plus
    if len(plus) == 1:
        total += plus
    else:
        over = np.zeros(plus.shape[1], bool)
        for k in range(len(plus)):
            x = total[k] + plus[k]
            carried = x < plus[k]
            total[k] = x + over
            over = carried | (over & (total[k] == 0))
    total ^= plus
    total |= same
    total |= minus
    up = minus | ~(total | plus)
    less = total & plus
    kept = (total[-1] >> np.uint64(63)).astype(np.int64)
    down = total >> np.uint64(1)
    down[:-1] |= total[1:] << np.uint64(63)
    return less | ~(down | up), down & up, kept


def laid(data: np.ndarray, start: np.ndarray, size: np.ndarray, before: np.ndarray, width: int) -> np.ndarray:
    """A row per text: ``before`` zeros, its characters, and ones up to ``width``."""
    at = np.arange(width) - before[:, None]
    out = data[np.minimum(np.maximum(at, 0) + start[:, None], max(0, len(data) - 1))] if len(data) else np.zeros(at.shape, data.dtype)
    out[at < 0] = 0
    out[at >= size[:, None]] = 1
    return out


def packed_bits(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.packbits(x, axis=1, bitorder="little").view("<u8").T)
