"""Merges in numpy against the plain rule, and that encoding takes no expression step a merge."""

import random

import numpy as np

from tidemark.llm import byte_bpe, registry


def by_hand(word, tokens):
    parts = [bytes([b]) for b in word]
    while True:
        found = [(tokens[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in tokens]
        if not found:
            return [tokens[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merges_equal_the_rule_for_words_of_any_length():
    r = random.Random(3)
    tokens = byte_bpe.tokens_of(registry.VOCABULARY)
    merges = byte_bpe.Merges(tokens)
    words = ["".join(r.choice(["a", "e", "th", "ing", " ", "é", "漢", "\x00", "0"]) for _ in range(r.randint(1, n))).encode() for n in (2, 5, 12, 70, 200) for _ in range(60)]
    words += [b"a" * n for n in (1, 2, 3, 64, 65, 400)] + [b"\xff\x00" * 3, b" " * 99]
    for word, text in zip(words, merges.strings(words)):
        assert byte_bpe._tokens(text).tolist() == by_hand(word, tokens), word
        if len(word) > 1:
            assert merges.folded_long(word).tolist() == by_hand(word, tokens), word


def test_marks_inside_texts_are_text(spark):
    texts = ["a\U0010fffeb \U0010fffe", "\U0010fffe\U0010fffe", "zqxj" + "\U0010ffff", "\0\0", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found, codec, name = byte_bpe.encoded(docs, registry.VOCABULARY, common=0)
    plan = found._jdf.queryExecution().toString()
    assert "aggregate(" not in plan and "reduce" not in plan
    back = {r.doc_id: r.back for r in codec.decoded(found, name, "back").collect()}
    assert [bytes(back[i]) for i in range(6)] == [(t or "").encode() for t in texts]
    assert byte_bpe._tokens(byte_bpe._characters(np.array([0, 0xD7FF, 0xD800, 60000]))).tolist() == [0, 0xD7FF, 0xD800, 60000]
