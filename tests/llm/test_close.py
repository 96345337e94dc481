"""Many pairs of lines compared at once."""

import random

import numpy as np
import pyarrow as pa

from tidemark.llm import edits


def test_pairs_compared_at_once_are_close_when_their_distance_says_so(monkeypatch):
    r = random.Random(5)
    alone = []
    for alphabet in ("ab", "abcdefgh ", "abé漢👍 "):
        texts = []
        for _ in range(240):
            n = r.choice((0, 1, 5, 20, 70, 300, 900))
            x = [r.choice(alphabet) for _ in range(n)]
            y = list(x)
            for _ in range(r.choice((0, 1, 2, n // 20, n // 10, n // 8, n // 4))):
                at = r.randrange(len(y) + 1)
                y[at : at + r.randint(0, 2)] = [r.choice(alphabet) for _ in range(r.randint(0, 2))]
            texts += ["".join(x), "".join(y)]
        a = np.arange(0, len(texts), 2)
        real = np.array([edits.distance(texts[p], texts[p + 1]) for p in a])
        tenth = np.array([max(len(texts[p]), len(texts[p + 1])) // 10 for p in a])
        for most in (tenth, np.maximum(0, real - 1), real, real + 1):
            column = pa.array(["sliced off", *texts])[1:]
            assert (edits.close(column, a, a + 1, most, lambda x, y, m: alone.append(x) or edits.distance(x, y, m)) == (real <= most)).all()
            assert (edits.close(column, a + 1, a, most) == (real <= most)).all()
    assert len(alone) < 150  # of 2880
