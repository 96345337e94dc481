"""Bounds of edit distances, and the work that line dedup does on lines that only seem alike."""

import random

import numpy as np
import pyarrow as pa

from tidemark.llm import edits, fuzzy_lines


def test_tallies_bound_the_distance_from_below():
    r = random.Random(4)
    texts = ["", "a", "ab漢é", *("".join(r.choice("abcdeé漢👍 1") for _ in range(r.randint(0, 30))) for _ in range(80))]
    counts = edits.tallies(pa.array(["x", *texts])[1:])
    assert counts.sum(axis=1).tolist() == [len(x) for x in texts]
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    bound = edits.least(counts[a], counts[b])
    assert all(x <= edits.distance(texts[p], texts[q]) for x, p, q in zip(bound.tolist(), a.tolist(), b.tolist()))
    assert edits.least(edits.tallies(pa.array(["aaaa"])), edits.tallies(pa.array(["aabb"]))).tolist() == [2]


def test_unlike_lines_of_a_bucket_are_not_spelled_out(spark, monkeypatch):
    r = random.Random(8)
    lines = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(60)) for _ in range(40)]
    lines.append(lines[0][:-1] + "#")
    rows = spark.createDataFrame([(1, i, i, 60, 0) for i in range(41)], "key long, node long, component long, n int, bits long")
    texts = spark.createDataFrame(list(enumerate(lines)), "node long, text string")
    asked = spark.sparkContext.accumulator(0)

    def counted(a, b, most=None):
        asked.add(1)
        return edits.distance(a, b, most)

    monkeypatch.setattr(fuzzy_lines, "distance", counted)
    assert [tuple(x) for x in fuzzy_lines.across(rows, texts).collect()] == [(0, 40)]
    assert asked.value == 1  # of 820 pairs
