import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.llm import hard_negatives as hn


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in rows], "vec_id bigint, embedding array<float>, label int, score string, slices int")


def brute(rows, step, k=5, m=3):
    seen, fine = set(), []
    for i, v, lab in rows:
        if i is None or lab is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        key = (i, lab, tuple(v))
        if key not in seen:
            seen.add(key)
            fine.append((i, [int(np.floor(256 * float(np.float32(x)))) for x in v], lab))
    out = []
    for i, v, lab in fine:
        if i % step:
            continue
        others = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, w, other in fine if j != i and len(w) == len(v)]
        for p, j, _ in sorted(x for x in others if x[2] == lab)[:k]:
            inside = sorted(x[:2] for x in others if x[2] != lab and 50 * -p <= 100 * -x[0] <= 95 * -p)
            out += [(i, j, r, n, -p, -s) for r, (s, n) in enumerate(inside[:m], 1)]
    return sorted(out)


def found(spark, rows, step, **how):
    got = hn.mine_hard_negatives(frame(spark, rows), F.col("id") % step == 0, **how)
    return sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("scale", [1.0, 3e5])  # floats, then 64-bit integers
def test_against_brute_force(spark, scale):
    rnd = np.random.default_rng(4)
    centre = rnd.standard_normal((6, 20))
    rows = []
    for i in range(700):
        lab = int(rnd.integers(0, 6)) if i % 3 else 0  # a hot label
        rows.append((i, [float(np.float32(x)) for x in scale * (centre[lab] + 0.9 * rnd.standard_normal(20) + 0.4)], lab))
    rows += [(700 + i, rows[10][1], int(i % 2)) for i in range(60)]  # copies: ties within and across labels
    got = found(spark, rows, 10, slice_rows=90, block=16)
    assert got == brute(rows, 10) and len(got) > 300


def test_scan_prunes_and_keeps_what_counts():
    rnd = np.random.default_rng(5)
    m = rnd.integers(-200, 200, (3000, 64))
    m[:, :8] *= 10  # a few large dimensions decide
    row = {"ids": np.arange(3000).tobytes(), "hashes": np.zeros(3000, np.int64).tobytes(), "labels": np.zeros(3000, np.int64).tobytes(),
           "columns": [np.ascontiguousarray(m[:, d]).tobytes() for d in range(64)]}
    part, left = hn.Slice(row, 2000), []
    a = m[0]

    def watch(low, high):
        left.append(len(low))
        return hn.best_of(5)(low, high)

    at, score = part.scan(a, np.arange(3000) != 0, watch)
    want = np.sort(m[1:] @ a)[::-1][:5]
    assert np.sort(score)[::-1][:5].tolist() == want.tolist() and (score == m[at] @ a).all()
    assert left[0] == 2999 and left[-1] < 300


def test_edges(spark):
    ok = [1.0, 0.5]
    rows = [(0, ok, 1), (50, None, 1), (1, [1.0, None], 1), (2, [float("nan"), 1.0], 1), (3, [float("inf"), 1.0], 2), (4, ok, None), (None, ok, 1),
            (5, [2.0, 1.0], 1), (5, [2.0, 1.0], 1), (6, [1.4, 0.7], 2), (7, [1.5, 0.7], 3), (0, [1.5, 0.7], 2), (8, [1.0, 1.0, 1.0], 2), (100, [], 1), (9, [-1.0, 0.0], 1)]
    assert found(spark, rows, 50) == brute(rows, 50) != []
    assert found(spark, [], 50) == [] and found(spark, [(0, ok, 1)], 50) == [] and found(spark, [(1, ok, 1), (2, ok, 1)], 50) == []
    zero = [(0, [0.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [3.0, 0.0], 2)]  # a positive with score 0 takes negatives of score 0
    assert found(spark, zero, 50) == [(0, 1, 1, 2, 0, 0)]
