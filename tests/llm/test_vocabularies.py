"""Alignment, byte-level BPE and spelling variants against the tokenizers' own libraries and brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import byte_bpe, registry, spelling, token_alignment

ODD = [
    "a", "B", "é", " ", "  ", "\n", "\t", "'s", "'S", "'ll", "1", "23", "²", "½", "!", "..", "<|endoftext|>", "<s>", "<0x41>", "▁", "漢", "　", "​",
    "\x00", "\x1f", "ẞ", "👍🏽", "_", "\r\n", "the", "ing", "漢字", "\U00010d4a", "\U00010d40", "fi",
]
CLASHES = "doc_id {}, text string, tokens string, known int, pairs int, pieces int, row long, n_a int, word string, n long"


def texts(seed=3, n=250):
    r = random.Random(seed)
    out = ["".join(r.choice(ODD) for _ in range(r.randint(0, 60))) for _ in range(n)]
    out += ["".join(r.choice("abcdeéßtionxxx") for _ in range(r.randint(60, 300))) for _ in range(40)]
    out += [" ".join(r.choice(["the", "cat", "of", "information", "gehen", "x."]) for _ in range(r.randint(0, 60))) for _ in range(80)]
    return [*out, None, "", " " * 5000, "x" * 8000, "ab" * 2000, "漢字かな" * 300, "na " * 20000, out[0], out[0]]


def table(spark, values, kind="long"):
    ids = range(len(values)) if kind == "long" else [None if i == 3 else f"d{i}" for i in range(len(values))]
    return spark.createDataFrame([(i, t, "x", 1, 1, 1, 7, 1, "y", 2) for i, t in zip(ids, values, strict=True)], CLASHES.format(kind))


def test_byte_bpe_equals_tiktoken(spark):
    tiktoken = pytest.importorskip("tiktoken")
    own = tiktoken.Encoding(
        "own", pat_str=r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", mergeable_ranks=byte_bpe.tokens_of(registry.VOCABULARY), special_tokens={}
    )
    values = texts()
    got = {r.doc_id: r for r in byte_bpe.digests(table(spark, values).repartition(4), registry.VOCABULARY).collect()}
    assert len(got) == len(values)
    for i, text in enumerate(values):
        ids = own.encode_ordinary(text or "")
        want = len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want, text
    found, codec, name = byte_bpe.encoded(table(spark, ["It's 12 o'clock", None], "string"), registry.VOCABULARY, common=0)
    assert name == "tokens_" and found.columns[:3] == ["doc_id", "text", "tokens"]
    assert [r.x for r in found.select(codec.ids(found[name]).alias("x")).collect()] == [own.encode_ordinary("It's 12 o'clock"), []]
    assert byte_bpe.digests(table(spark, []), registry.VOCABULARY).collect() == []


def bytes_a(tokenizer, ids):
    """Byte-level characters back to bytes, by the public rule of the format."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    return [bytes(of[c] for c in tokenizer.id_to_token(i)) for i in ids]


def bytes_b(processor, ids):
    return [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(processor.id_to_piece, ids)]


def aligned_by_hand(rows):
    tokenizer, (processor, _) = token_alignment.whole(token_alignment.FILE_A), token_alignment.sentence_pieces(token_alignment.FILE_B)
    out, counts = {}, Counter()
    for d, text in rows:
        a, b, groups, links = [], [], [], []
        if text:
            a, b = tokenizer.encode(" " + text, add_special_tokens=False).ids, processor.encode(text)
            x, y = bytes_a(tokenizer, a), bytes_b(processor, b)
            if b"".join(x) != (" " + text).encode() or b"".join(y) != (" " + text).encode():
                a, b = [], []
            else:
                ends_a, ends_b = np.cumsum([len(t) for t in x]).tolist(), np.cumsum([len(t) for t in y]).tolist()
                at_b, i, j = dict(zip(ends_b, b, strict=True)), 0, 0
                for k, e in enumerate(ends_a):
                    if e in at_b:
                        links.append((a[k], at_b[e]))
                        m = ends_b.index(e, j) + 1
                        groups.append(",".join(map(str, a[i : k + 1])) + "|" + ",".join(map(str, b[j:m])))
                        i, j = k + 1, m
        out[d] = a, b, groups, links
        counts.update(links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return {
        d: (len(a), len(b), len(g), len(li), sum(counts[x] == best[x[1]] for x in li), sum(counts[x] for x in li), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "")
        for d, (a, b, g, li) in out.items()
    }


@pytest.mark.parametrize("hot", [1, 60, 1 << 16])
def test_alignment_equals_brute_force(spark, hot):
    pytest.importorskip("sentencepiece")
    values = texts(5, 200)
    want = aligned_by_hand(enumerate(values))
    got = token_alignment.scored(table(spark, values).repartition(3), hot=hot).collect()
    assert len(got) == len(values)
    for r in got:
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == want[r.doc_id], values[r.doc_id]


def test_alignment_of_odd_tables(spark):
    pytest.importorskip("sentencepiece")
    assert token_alignment.scored(table(spark, [])).collect() == []
    got = token_alignment.scored(table(spark, ["same text"] * 5 + [None], "string")).collect()
    assert sorted((r.doc_id or "", r.n_a > 0) for r in got) == [("", True), ("d0", True), ("d1", True), ("d2", True), ("d4", True), ("d5", False)]
    a, b = token_alignment.overlaps(np.array([0, 2, 5]), np.array([0, 0, 1]), np.array([0, 1, 3, 5]), np.array([0, 0, 0, 1]))
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 0), (0, 1), (1, 1), (1, 2), (2, 3)]


def spelled_by_hand(rows):
    counts = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def one_edit(x, y):
        if len(x) > len(y):
            x, y = y, x
        if len(x) == len(y):
            return sum(p != q for p, q in zip(x, y, strict=True)) == 1
        return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))

    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    first = {w: min(v, key=lambda x: (-words[x], x)) for w, v in near.items() if v}
    form = {w: v for w, v in first.items() if words[v] >= 5 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


@pytest.mark.parametrize("pass_bytes", [1 << 25, 300])
def test_spelling_equals_brute_force(spark, pass_bytes):
    r = random.Random(9)
    letters = "abcdeéÿÀZ"
    base = ["".join(r.choice(letters) for _ in range(r.randint(5, 9))) for _ in range(60)]
    family = ["aaaaaa", "aaaaaaa", "aaaaaab", "baaaaaa", "aaaaabb"]
    weights = {w: r.choice([5, 6, 30, 160, 900]) for w in base + family}
    for w in base[:40]:
        i = r.randrange(len(w))
        weights[w[:i] + r.choice([r.choice(letters) + w[i:], w[i + 1 :], r.choice(letters) + w[i + 1 :]])] = r.choice([4, 5, 25, 200])
    flat = [w for w, n in weights.items() for _ in range(n)]
    r.shuffle(flat)
    values = ["1".join(flat[i : i + 90]) for i in range(0, len(flat), 90)] + [None, "", "x" * 3000, " ".join(["Straße"] * 7)]
    values += [values[0], values[0]]
    assert {tuple(x) for x in spelling.grouped(table(spark, values), pass_bytes=pass_bytes).collect()} == spelled_by_hand(enumerate(values))


def test_spelling_of_odd_tables(spark):
    assert spelling.grouped(table(spark, [])).collect() == [] and spelling.grouped(table(spark, [None, "", "too few"])).collect() == []
    odd = table(spark, ["letter " * 9] * 6, "string")
    assert {tuple(x) for x in spelling.grouped(odd).collect()} == spelled_by_hand([(r.doc_id, r.text) for r in odd.collect()])


def test_filters_have_no_false_negative():
    words = [w.decode("latin-1") for w in {bytes(random.Random(i).choices(range(97, 123), k=8)) for i in range(3000)}]
    chars = np.concatenate(list(spelling.matrices(words)))
    known = spelling.Filters({8: len(words)})
    block, bits = spelling.places(spelling.hashes(chars), known.blocks[8])
    np.bitwise_or.at(known.data, block, bits)
    assert known.hit(spelling.hashes(chars), 8).all()
    other = np.random.default_rng(1).integers(0xC0, 0x100, (20000, 8)).astype(np.uint8)
    assert known.hit(spelling.hashes(other), 8).mean() < 0.01
