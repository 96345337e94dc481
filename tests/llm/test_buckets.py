"""Keys that lines share: pairs leave the task where a key has few lines, rows where it has many."""

import random

from tidemark.llm import fuzzy_lines, linking
from tidemark.llm.rows import keyed


def test_few_lines_of_a_key_leave_their_task_as_pairs_that_fit(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    one, many = [word() for _ in range(30)], [word() for _ in range(30)]
    lines = [" ".join(one), " ".join([*one[:-1], "other"])]
    lines += [" ".join([*many[:i], "changed", *many[i + 1 :]]) for i in range(linking.SMALL + 4)]
    lines += [f"alone {i} " + " ".join(word() for _ in range(20)) for i in range(20)]
    docs = keyed(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    node = {x.doc_id: x.node for x in fuzzy_lines.placed_lines(docs).collect()}
    sent = fuzzy_lines.buckets(docs, 3).collect()
    pairs = {(x.node, x.other) for x in sent if x.other is not None}
    assert tuple(sorted((node[0], node[1]))) in pairs
    rows = [x for x in sent if x.other is None]
    assert {x.node for x in rows} == {node[i] for i in range(2, linking.SMALL + 6)}
    assert all((x.n, x.times > 0) == (len(lines[next(i for i in node if node[i] == x.node)]), True) for x in rows)


def test_what_is_told_of_a_line_is_read_again():
    import numpy as np

    size = np.array([1, 85, 86, 127, 128, 1 << 20], np.int32)
    bits = np.arange(6, dtype=np.uint64) << np.uint64(60) | np.uint64(5)
    elsewhere = np.array([True, False, True, False, False, True])
    n, b, e = fuzzy_lines.untold(fuzzy_lines.told(size, bits, elsewhere), 6)
    assert n.tolist() == size.tolist() and e.tolist() == elsewhere.tolist() and b.tolist() == [0, 0, *bits[2:].tolist()]
