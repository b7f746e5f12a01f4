import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidewake.llm import lexical, terms
from tidewake.llm.common import TO_LOWER


def words(t):
    return re.findall(terms.TERM, (t or "").translate(TO_LOWER))


def brute(docs, items, k=10):
    counted = [(i, Counter(words(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(w for _, c, _ in counted for w in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(words(t))
    out = []
    for i, wanted in asked.items():
        ranked = []
        for d, c, n in counted:
            m = 10 + (90 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in wanted if c[w])
            if s > 0 and d is not None:
                ranked.append((-s, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(ranked)[:k], 1)]
    return sorted(out)


def found(spark, docs, items, **how):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id bigint, text string, score string, terms int")
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, doc_id string")
    return sorted(tuple(r) for r in lexical.lexical_search(d, q, **how).select("item_id", "rank", "doc_id", "score").collect())


def corpus(seed, n):
    rnd = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["été", "ÉTÉ", "naïve", "日本"]
    pick = lambda m: " ".join(vocabulary[min(int(x), 403)] for x in rnd.zipf(1.3, m) - 1)
    docs = [(i, pick(int(rnd.integers(1, 80)))) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(30)] + [docs[5], docs[5]]  # copies and repeated rows: ties
    return docs, [(i, pick(int(rnd.integers(1, 30)))) for i in range(90)]


def test_against_brute_force(spark):
    docs, items = corpus(1, 600)
    assert found(spark, docs, items) == brute(docs, items)


def test_passes_and_parts_do_not_matter(spark, monkeypatch):
    docs, items = corpus(2, 200)
    monkeypatch.setattr(lexical, "ITEMS", 7)
    assert found(spark, docs, items, per_pass=60) == brute(docs, items)
    # parts of the vocabulary and small tiles of documents, without Spark
    cells = [(i, Counter(words(t))) for i, t in docs]
    names = {w: j for j, w in enumerate(sorted({w for _, c in cells for w in c}))}
    row = {"items": [1, 2], "terms": sorted(names.values()), "row": [0] * len(names) + [1] * 5, "col": [*range(len(names)), *range(5)], "w": [3] * len(names) + [7] * 5}
    want = None
    for size in (5, 4096):
        monkeypatch.setattr(lexical, "TERMS", size)
        tile = lexical.ItemTile(row, 10)
        at = [(names[w], j, tf) for j, (_, c) in enumerate(cells) for w, tf in c.items()]
        t, d, tf = (np.array(x) for x in zip(*at))
        got = tile.scores(t, d, tf, len(cells))
        assert want is None or (got == want).all()
        want = got


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "?! -"), (None, "alpha beta"), (4, "Alpha alpha"), (5, "beta " * 50_000), (6, "alpha"), (6, "alpha"), (7, "x" * 300_000 + " alpha")]
    items = [(1, "ALPHA alpha"), (1, "alpha"), (2, None), (None, "alpha"), (3, "nothing here"), (4, "beta, alpha"), (5, "")]
    got = found(spark, docs, items)
    assert got == brute(docs, items) and {r[0] for r in got} == {1, 4}
    assert found(spark, [], items) == [] and found(spark, docs, []) == []


def test_word_prints_cross_no_border():
    texts = pa.array(["Ab cd", None, "", "ef", "ab", "c\x00d É", "x" * 700], pa.string())
    for t in (texts, pa.concat_arrays([pa.array(["zz z"]), texts]).slice(1)):
        prints, upto = terms.word_prints(t)
        assert upto.tolist() == [0, 2, 2, 2, 3, 4, 7, 8]
        assert prints[0] == prints[3] and len(set(prints.tolist())) == 7
    assert terms.word_prints(pa.array([], pa.string()))[1].tolist() == [0]


@pytest.mark.parametrize("size", [1, 5000])
def test_bit_table_lets_all_members_through(spark, size):
    rnd = np.random.default_rng(3)
    own = rnd.integers(0, 1 << 64, size, dtype=np.uint64)
    df = spark.createDataFrame([(int(x),) for x in own.view(np.int64)], "h bigint")
    table, bits = terms.bit_table(df, "h", size)
    assert len(terms.may_hold(table, bits, own)) == size
    assert len(terms.may_hold(table, bits, rnd.integers(0, 1 << 64, 100_000, dtype=np.uint64))) < 2000
