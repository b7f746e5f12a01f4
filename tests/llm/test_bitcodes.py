import numpy as np
from pyspark.sql import functions as F

from tidewake.llm import bitcodes


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(None if i is None else int(i), None if v is None else [None if x is None else float(x) for x in v], "x") for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score string")


def brute(vectors, step, k):
    m = np.array(vectors, np.float32).astype(float)
    out = {}
    for q in range(0, len(m), step):
        s = (m * m[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(len(m)), -s)) if i != q][:k]
        out[q] = order
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def test_recall_against_brute_force(spark):
    rnd = np.random.default_rng(1)
    v = rnd.standard_normal((1500, 48)) * rnd.uniform(0.5, 2, (1500, 1)) + 0.2
    v[700:760] = v[3]  # ties, also of a query's own vector
    v[4] = v[3]
    got = result(bitcodes.nearest_neighbours(table(spark, v), F.col("id") % 20 == 0, block=32, slice_rows=400))
    want = brute(v, 20, 20)
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert set(got) == set(want) and hits >= 0.99 * 20 * len(want)
    assert all(len(x) == 20 for x in got.values())


def test_estimates_stay_in_bounds():
    rnd = np.random.default_rng(2)
    v, q = rnd.standard_normal((400, 96)), rnd.standard_normal((50, 96))
    codes, norm, corr = bitcodes.encode(v)
    planes = bitcodes.QueryPlanes(q)
    guess = planes.code_products(codes) * (norm / corr)
    spread = bitcodes.EPS * np.sqrt(1 - corr**2) / corr / np.sqrt(95) * norm
    room = spread * planes.norm[:, None] + planes.slack[:, None] * (norm / corr)
    assert (np.abs(guess - q @ v.T) <= room).mean() > 0.999


def test_edges(spark):
    vectors = [[1, 0], [0, 0], None, [1, None], [float("nan"), 1], [float("inf"), 1], [2, 1], [2, 1], [1, 2, 3], [], [1, 1]]
    ids = [0, 20, 40, 60, 80, 100, 7, 7, 120, 140, None]
    got = bitcodes.nearest_neighbours(table(spark, vectors, ids), F.col("id") % 20 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 7, 2.0)]
    assert bitcodes.nearest_neighbours(table(spark, []), F.col("id") % 20 == 0).count() == 0


def test_most_pairs_are_dropped_by_products():
    """Loose bounds leave many pairs; few of them are scored one by one, and the best are those of brute force."""
    rng = np.random.default_rng(3)
    v = rng.standard_normal((6000, 64))
    v[4000:4050] = v[0]
    ids = np.arange(len(v))
    codes, norm, corr = bitcodes.encode(v)
    seen = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, np.ndarray):
                seen.append(len(at))
            return np.asarray(self)[at]

    q, i, s = bitcodes.search_group(ids[:300], v[:300], ids, v.view(Counted), codes, norm, corr, 20)
    assert sum(seen) < 300 * len(v) / 8
    want = v[:300] @ v.T
    want[np.arange(300), np.arange(300)] = -np.inf
    best = np.argsort(-np.round(want, 9), axis=1, kind="stable")[:, :20]
    assert (i.reshape(300, 20) == best).all()
