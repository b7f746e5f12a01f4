import random

import numpy as np

from tidewake.llm import jaccard
from tidewake.llm.common import TO_LOWER, WORDS


def brute(rows):
    sets = {}
    for d, t in rows:
        w = WORDS.findall((t or "").translate(TO_LOWER))
        sets[d] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    up = {d: d for d in sets}

    def find(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed, n=160):
    """Copies, near copies in chains, shared passages, tiny and empty texts."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = [rnd.choice(words) for _ in range(40)]
    rows, texts = [], []
    for d in range(n):
        kind = rnd.random()
        if texts and kind < 0.25:
            w = list(rnd.choice(texts))
            for _ in range(rnd.randint(0, 3)):
                if w:
                    w[rnd.randrange(len(w))] = rnd.choice(words)
        elif kind < 0.4:
            w = [rnd.choice(words) for _ in range(rnd.randint(0, 12))] + passage
        elif kind < 0.5:
            w = [rnd.choice(words[:3]) for _ in range(rnd.randint(0, 4))]
        else:
            w = [rnd.choice(words) for _ in range(rnd.randint(5, 90))]
        texts.append(w)
        rows.append((d, " ".join(x.upper() if rnd.random() < 0.1 else x for x in w)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t\n")]


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_matches_brute_force(documents):
    rows = corpus(1)
    assert result(jaccard.jaccard_components(documents(rows, extra=True))) == brute(rows)


def test_split_groups_lose_no_link(documents):
    rows = corpus(2)
    assert result(jaccard.jaccard_components(documents(rows), max_group=4)) == brute(rows)


def test_threshold_is_inclusive(documents):
    base = [f"a{i}" for i in range(32)]  # 28 shingles; a changed last word leaves 27 of 29, four changed 24 of 32
    rows = [(1, " ".join(base)), (2, " ".join(base[:-4] + ["x", "y", "z", "q"])), (3, " ".join(base[:-5] + list("vwxyz")))]
    want = brute(rows)
    assert want[2][1] == 1 and want[3][1] == 3
    assert result(jaccard.jaccard_components(documents(rows))) == want


def test_nulls_repeats_and_empty(spark, documents):
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    got = jaccard.jaccard_components(documents([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, long), (8, long), (3, None)]))
    rows = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in got.collect())
    assert rows == [(False, 3, 0, 3), (False, 7, 2, 7), (False, 7, 2, 7), (False, 8, 29996, 8), (False, 9, 29996, 8), (True, 0, 2, None)]
    assert jaccard.jaccard_components(documents([])).count() == 0


def test_tree_prunes_only_what_cannot_link():
    rnd = np.random.default_rng(3)
    base = np.unique(rnd.integers(0, 1 << 63, 400, dtype=np.uint64))
    sets = []
    for _ in range(70):
        s = base.copy()
        at = rnd.integers(0, len(s), rnd.integers(0, 140))
        s[at] = rnd.integers(0, 1 << 63, len(at), dtype=np.uint64)
        sets.append(np.unique(s))
    labels = jaccard.join_group(sets)
    up = list(range(len(sets)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if jaccard.linked(sets[i], sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    want = [find(i) for i in range(len(sets))]
    groups = lambda x: {frozenset(np.flatnonzero(np.array(x) == k)) for k in set(x)}
    assert groups(labels.tolist()) == groups(want) and len(groups(want)) > 1


def test_bitmaps_prune_sets_of_any_length():
    rnd = np.random.default_rng(4)
    for n in (20, 400, 4000, 30_000):
        sets = [np.unique(rnd.integers(0, 1 << 63, n + int(rnd.integers(0, n // 4)), dtype=np.uint64)) for _ in range(40)]
        sets.append(np.sort(np.concatenate([sets[0][: len(sets[0]) * 9 // 10], rnd.integers(0, 1 << 63, len(sets[0]) // 10, dtype=np.uint64)])))
        sets.sort(key=len)  # two of them share nine tenths
        sizes = np.array([len(s) for s in sets])
        i, j = jaccard.possible_pairs([jaccard.bitmap(s) for s in sets], sizes, np.arange(len(sets)), 75)
        found = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())}
        linked = {(a, b) for b in range(len(sets)) for a in range(b) if jaccard.linked(sets[a], sets[b])}
        assert len(linked) == 1 and linked <= found and len(found) <= 3


def test_groups_give_members_not_pairs(spark):
    """A group of near copies in components of their own gives each member once."""
    rnd = np.random.default_rng(5)
    base = rnd.integers(0, 1 << 63, 300, dtype=np.uint64)
    rows = []
    for k in range(60):
        s = np.unique(np.concatenate([base, rnd.integers(0, 1 << 63, 5, dtype=np.uint64)]))
        rows.append((1, 0, 0, k, len(s), bytearray(jaccard.bitmap(s).tobytes()), k))
    other = np.unique(rnd.integers(0, 1 << 63, 300, dtype=np.uint64))
    rows.append((1, 0, 0, 99, len(other), bytearray(jaccard.bitmap(other).tobytes()), 99))
    df = spark.createDataFrame(rows, "grp bigint, sub int, part int, node bigint, size bigint, bits binary, comp bigint")
    assert sorted(r["node"] for r in jaccard.candidate_members(df).collect()) == list(range(60))
