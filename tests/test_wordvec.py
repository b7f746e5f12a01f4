"""Word vectors in slices."""

from collections import Counter
from heapq import heapify, heappop, heappush

import numpy as np
import pytest

from tidewake.operators import models, wordvec


def test_codes_are_as_short_as_a_huffman_tree():
    rnd = np.random.default_rng(2)
    for size in (1, 2, 3, 7, 40, 90):
        counts = sorted(rnd.zipf(1.5, size).clip(max=60).tolist(), reverse=True)
        num = wordvec.lengths(Counter(counts))
        heap, cost = list(counts), 0
        heapify(heap)
        while len(heap) > 1:
            both = heappop(heap) + heappop(heap)
            cost += both
            heappush(heap, both)
        ends, nodes, bits = wordvec.paths(np.arange(size), num)
        assert num.sum() == size and (np.diff(ends) * counts).sum() == cost
        assert set(nodes.tolist()) == set(range(size - 1)) and len(set(zip(nodes, bits))) == 2 * (size - 1)
    assert wordvec.lengths({}).tolist() == [0]


def test_pairs_stay_inside_a_document():
    word, near = wordvec.pairs(np.arange(30), np.array([0, 4, 4, 30]), np.random.default_rng(0))
    assert all((a < 4) == (b < 4) and 0 < abs(a - b) <= 5 for a, b in zip(word, near)) and set(word) == set(range(30))


def test_a_step_of_one_group_is_the_plain_update():
    rnd = np.random.default_rng(1)
    num = wordvec.lengths(Counter([5, 4, 3, 2, 1]))
    ends, nodes, bits = wordvec.paths(np.arange(5), num)
    x, y = rnd.normal(size=(5, 4)).astype(np.float32), rnd.normal(size=(4, 4)).astype(np.float32)
    got = wordvec.train(np.array([4, 4, 4]), np.array([0, 1, 0]), ends, nodes, bits, x, y, (0.1, 0.1), rnd)
    u, v, want = x.copy(), y.copy(), (1 - bits)[ends[4] : ends[5]]
    at = nodes[ends[4] : ends[5]]
    for c in (0, 1, 0):
        g = 0.1 * (want - 1 / (1 + np.exp(-y[at] @ x[c])))
        u[c] += g @ y[at]
        v[at] += g[:, None] * x[c]
    assert np.allclose(got[0], u, atol=1e-6) and np.allclose(got[1], v, atol=1e-6)


def test_words_of_one_kind_are_close_and_the_driver_sees_no_words(spark, monkeypatch):
    monkeypatch.setattr(wordvec, "BLOCK", 1500)
    monkeypatch.setattr(wordvec, "SLICE", 160)
    rnd = np.random.default_rng(3)
    rows = [(i, [f"{'ab'[i % 2]}{x}" for x in rnd.integers(0, 20, 60)]) for i in range(600)] + [(600, []), (601, None), (602, ["seldom"])]
    df = spark.createDataFrame(rows, "doc_id bigint, tokens array<string>")
    model, docs = models.word2vec_docs(df, "doc_id", "tokens", 16, min_count=2)
    assert model.slices > 1 and model.table.count() == model.slices and model.num.sum() == 40
    v = {r["term"]: np.array(r["vector"]) for r in model.vectors().collect()}
    assert len(v) == 40 and not any(isinstance(a, np.ndarray) and len(a) >= 40 for a in vars(model).values())
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    same = np.mean([cos(v[f"{k}{i}"], v[f"{k}{j}"]) for k in "ab" for i in range(20) for j in range(i)])
    other = np.mean([cos(v[f"a{i}"], v[f"b{j}"]) for i in range(20) for j in range(20)])
    assert same > other + 0.5
    got = {r["doc_id"]: np.array(r["vector"]) for r in docs.collect()}
    assert len(got) == 603 and not got[600].any() and not got[601].any() and not got[602].any()
    for i in (0, 77):
        assert got[i] == pytest.approx(np.mean([v[t] for t in rows[i][1]], axis=0), abs=1e-6)
