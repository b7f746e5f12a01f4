import re

import numpy as np

from tidewake.llm import decontaminate as dc
from tidewake.llm.common import TO_LOWER

TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(t):
    return re.findall(TERM, (t or "").translate(TO_LOWER))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n and i is not None else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(i)
    sizes = {len(w) for w in windows}
    out = []
    for i, t in docs:
        w, hit, its = words(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                got = windows.get(tuple(w[s : s + n]))
                if got:
                    hit.update(range(s, s + n))
                    its |= got
        out.append((i, len(w), len(hit), tuple(sorted(its))))
    return sorted(out, key=str)


def found(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id bigint, text string, row int, n_words string")
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, win string")
    return sorted([(r[0], r[1], r[2], tuple(r[3])) for r in dc.decontaminate(d, q).collect()], key=str)


def test_against_brute_force(spark):
    rnd = np.random.default_rng(7)
    pick = lambda n, m: [f"w{x}" for x in rnd.integers(0, m, n)]
    items = [(i, pick(int(n), 40)) for i, n in enumerate(rnd.integers(1, 30, 60))]
    items += [(60, items[8][1]), (61, [*items[9][1], *items[10][1]]), (62, ["a"] * 14), (63, ["w1", "w2"])]
    docs = []
    for i in range(300):
        w = pick(int(rnd.integers(0, 60)), 60)
        for _ in range(int(rnd.integers(0, 4))):  # whole, cut and changed passages, some of them side by side
            p = list(items[int(rnd.integers(0, 64))][1])
            a = int(rnd.integers(0, 4))
            p = p[a : len(p) - int(rnd.integers(0, 4))]
            if len(p) > 3 and rnd.random() < 0.3:
                p[len(p) // 2] = "changed"
            at = int(rnd.integers(0, len(w) + 1))
            w[at:at] = p
        docs.append((i, ", ".join(w).upper() if i % 5 == 0 else " ".join(w)))
    docs += [(400 + i, " ".join(items[11][1])) for i in range(100)]  # a passage that many share
    docs += [(600, "a " * 30)]
    got = found(spark, docs, [(i, " ".join(w)) for i, w in items])
    assert got == brute(docs, [(i, " ".join(w)) for i, w in items])
    assert 50 < sum(r[2] == 0 for r in got) < 300


def test_near_misses_stay_clean(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, "one two three four five six seven eight nine"), (2, "x " + item), (3, item.replace("six", "sixth")),
            (4, "two three four five six seven eight nine ten eleven"), (5, "one two three four five. Six; seven eight NINE ten"),
            (6, "one two three four five x six seven eight nine ten eleven")]
    assert [r[2] for r in found(spark, docs, [(7, item)])] == [0, 11, 0, 10, 10, 0]


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "?!"), (None, "été à Paris"), (4, "été à paris " * 20_000), (5, "Paris"), (5, "Paris"), (6, "étéà paris")]
    items = [(1, None), (2, ""), (None, "paris"), (3, "été à PARIS"), (3, "paris"), (3, "paris"), (4, "paris")]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, [], items) == []
    assert [r[2] for r in found(spark, docs, [])] == [0] * len(docs) == [r[2] for r in found(spark, docs, [(1, "?")])]
