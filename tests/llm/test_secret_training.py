"""What the secret network learns from: every window of every document, whatever the partitions."""

import random

import numpy as np

from tidemark.llm import secrets


def test_training_takes_all_windows_in_any_partitions(spark, monkeypatch):
    r = random.Random(11)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows = [(i, f"{word(14)} password={r.getrandbits(64):016x} {word(13)}") for i in range(1700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    base = [secrets.base_spans(t) for _, t in rows]
    want = [sum(len(secrets.candidates(t, b)) for (_, t), b in zip(rows, base)), sum(map(len, base))]
    learned, seen = secrets.learned, []

    def spied(averaged, held, counts, slices, *rest):
        parts = [averaged(at, lambda _, chunk: np.bincount(chunk.kind, minlength=3)) for at in range(slices)]
        kinds = np.sum([total for total, n in parts if n], axis=0)
        net = learned(averaged, held, counts, slices, *rest)
        seen.append((counts[:2], kinds[:2].tolist(), net.vector().tobytes(), net.threshold, int(held(net)[:, 2].sum())))
        return net

    monkeypatch.setattr(secrets, "learned", spied)
    for some in (docs.coalesce(1), docs.repartition(5)):
        secrets.trained_on(secrets.found(some))
    assert seen[0][:2] == (want, want) and want[0] >= 3400 and want[1] >= 3400  # beyond any bound of a sample
    assert seen[0] == seen[1]
    assert seen[0][4] > sum(want) / 8  # a fifth, and of made tokens
