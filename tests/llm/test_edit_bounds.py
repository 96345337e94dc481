"""Bounds that spare comparing long lines: they never tell another side of the limit than the distance does."""

import random

from tidemark.llm import edits


def test_bounds_hold_and_spare_comparisons():
    r = random.Random(12)
    words = ["".join(r.choice("abcdeé漢👍") for _ in range(r.randint(1, 9))) for _ in range(400)]
    spared = 0
    for n in (3, 12, 30, 60):
        for k in range(60):
            x = [r.choice(words) for _ in range(n)]
            y = list(x)
            for _ in range(r.choice((0, 1, 2, n // 8, n // 4, n))):
                at = r.randrange(len(y) + 1)
                y[at : at + r.randint(0, 2)] = [r.choice(words) for _ in range(r.randint(0, 2))]
            a, b = " ".join(x), " ".join(y)
            if k % 3 == 0:
                b = "".join(c for c in b if r.random() < 0.97)
            real = edits.distance(a, b)
            assert edits.apart(a, b) <= real <= edits.aligned(a, b, 1 << 30), (a, b)
            for most in (0, real - 1, real, real + 1, max(len(a), len(b)) // 10):
                if most >= 0:
                    assert (edits.distance(a, b, most) <= most) == (real <= most)
            most = max(len(a), len(b)) // 10
            spared += edits.aligned(a, b, most) <= most or edits.apart(a, b) > most
    assert spared > 120  # of 240
