"""Tables replaced in one step, shard ledgers, keyed state, isolation trees, isotonic fits, factors, indexes and buckets."""

import math
import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.operators import factor, index, isolation, isotonic, models, nearest, retrieval, textops
from tidewake.session import shared_dir
from tidewake.sources import versions as vs
from tidewake.streaming import streams as st


def folder(spark):
    return f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"


# ---- S10, S13 ----
def test_a_job_killed_before_it_publishes_leaves_the_old_table(spark):
    path = folder(spark)
    with pytest.raises(FileNotFoundError):
        vs.read_table(spark, path)
    vs.replace_table(spark.range(5), path)
    vs.stage(spark.range(100), path)  # written, then killed
    assert vs.read_table(spark, path).count() == 5
    before = vs.read_table(spark, path)
    vs.replace_table(vs.read_table(spark, path).selectExpr("id + 1 as id"), path)  # reads the table that it replaces
    assert sorted(r[0] for r in vs.read_table(spark, path).collect()) == [1, 2, 3, 4, 5]
    assert before.count() == 5  # a reader of the old state goes on
    assert vs.expire(spark, path, keep=1) == 2 and vs.read_table(spark, path).count() == 5


def test_a_job_that_fails_while_writing_leaves_the_old_table(spark):
    path = folder(spark)
    vs.replace_table(spark.range(5), path)
    with pytest.raises(Exception):
        vs.replace_table(spark.range(5).select(F.raise_error(F.lit("killed")).alias("id")), path)
    assert vs.read_table(spark, path).count() == 5


def test_shards_are_taken_once(spark):
    source, out = folder(spark), folder(spark)
    add = lambda i: spark.range(i * 10, i * 10 + 10).coalesce(1).write.parquet(f"{source}/day={i}")
    add(0)
    add(1)
    assert vs.take_new_shards(spark, source, out) == 2 and vs.take_new_shards(spark, source, out) == 0
    add(2)
    assert vs.stage_new_shards(spark, source, out)[1] == 1  # died before it published
    assert vs.read_shards(spark, out).count() == 20
    assert vs.take_new_shards(spark, source, out, transform=lambda d: d.where("id % 2 = 0")) == 1
    assert vs.take_new_shards(spark, source, out) == 0
    assert sorted(r["id"] for r in vs.read_shards(spark, out).collect()) == [*range(20), 20, 22, 24, 26, 28]


# ---- X05 ----
def run_batches(spark, batches, **how):
    """Rows (batch file by file) through the running state; gives (order, prior_count, prior_volume, first_seen)."""
    source, base = folder(spark), folder(spark)
    schema = "user_id bigint, ts timestamp, event_id bigint, value double, kind string"
    out = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "user_id bigint, s string, event_id bigint, value double, kind string").withColumn("ts", F.to_timestamp("s")).drop(
            "s").select("user_id", "ts", "event_id", "value", "kind").coalesce(1).write.mode("append").parquet(f"{source}/b{i}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(source)
        got = st.run_available(st.stream_running_state(stream, "user_id", "ts", "event_id", "value", "kind", **how), f"{base}/out", f"{base}/ckpt")
        out = sorted(tuple(r) for r in got.select("event_id", "prior_count", "prior_volume", "first_seen").collect())
    return out, base


def test_running_state_over_two_batches_drops_late_rows(spark):
    first = [(1, "2024-01-01 10:00:00", 1, 5.0, "a"), (1, "2024-01-01 10:05:00", 3, 1.0, "b"), (1, "2024-01-01 10:01:00", 2, None, "a"), (2, "2024-01-01 10:00:00", 4, 7.0, "a")]
    second = [(1, "2024-01-01 10:06:00", 5, 2.0, "a"), (1, "2024-01-01 08:00:00", 6, 99.0, "z"), (1, "2024-01-01 10:06:00", 7, 2.0, "c")]
    got, _ = run_batches(spark, [first, second], late="30 minutes", idle="10 days")
    assert got == [(1, 0, 0.0, 1), (2, 1, 5.0, 0), (3, 2, 5.0, 1), (4, 0, 0.0, 1), (5, 3, 6.0, 0), (7, 4, 8.0, 1)]


def test_running_state_ends_after_idle_time(spark):
    day = lambda d, e, u=1, k="a": (u, f"2024-01-{d:02d} 10:00:00", e, 1.0, k)
    got, base = run_batches(spark, [[day(1, 1), day(1, 2, 2)], [day(9, 3, 2)], [day(10, 4, 2)], [day(10, 5)]], late="1 hour", idle="2 days")
    assert got == [(1, 0, 0.0, 1), (2, 0, 0.0, 1), (3, 0, 0.0, 1), (4, 1, 1.0, 0), (5, 0, 0.0, 1)] or got[-1] == (5, 0, 0.0, 1)
    assert any("state" in d for d in os.listdir(f"{base}/ckpt"))


# ---- T25 ----
def walk(x, tree):
    f, c, k, h = tree
    i, depth = 0, 0
    while k[i] != i:
        i, depth = k[i] + int(x[f[i]] >= c[i]), depth + 1
    return i, depth


def test_trees_are_rows_and_scores_fall_with_depth(spark):
    rnd = np.random.default_rng(1)
    x = np.vstack([rnd.standard_normal((800, 2)), [[9.0, -9.0], [0.0, 0.0]]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id bigint, a double, b double")
    trees = isolation.fit_trees(df, "id", ["a", "b"], 20, 256)
    rows = trees.collect()
    assert len(rows) == 20 and {r["size"] for r in rows} == {256}
    model = [isolation.unpack(r, 2) for r in rows]
    paths = np.zeros(len(x))
    for tree in model:
        ends = [walk(r, tree) for r in x]
        assert max(d for _, d in ends) <= math.ceil(math.log2(256))
        paths += [tree[3][i] for i, _ in ends]
        assert all(tree[3][i] >= d for i, d in ends)  # a leaf's height is its depth and what its rows still add
    got = {r["id"]: r["s"] for r in isolation.raw_scores(df, trees, ["a", "b"], "s").collect()}
    want = 2.0 ** (-paths / 20 / float(isolation.average_path(256)))
    assert np.allclose([got[i] for i in range(len(x))], want)
    order = np.argsort(paths)
    assert (np.diff([got[i] for i in order]) <= 1e-12).all() and order[0] == 800
    again = isolation.fit_trees(df.repartition(5), "id", ["a", "b"], 20, 256).collect()
    assert sorted(bytes(r["cut"]) for r in rows) == sorted(bytes(r["cut"]) for r in again)


def test_scores_are_scaled_by_the_training_rows(spark):
    rows = [(i, float(i % 17), float(i % 5)) for i in range(400)] + [(900, 500.0, -500.0), (901, None, float("nan")), (902, float("inf"), 3.0)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double")
    got = {r["id"]: r["anomaly"] for r in isolation.iforest_score(df, "id", ["a", "b"], F.col("id") < 400, 15, 128).collect()}
    inside = [got[i] for i in range(400)]
    assert min(inside) == 0.0 and max(inside) == 1.0 and 0.8 < got[900] <= 1 and 0 <= got[901] <= 1 and 0 <= got[902] <= 1
    same = df.where("id < 400").withColumn("a", F.lit(1.0)).withColumn("b", F.lit(1.0))
    assert {r["anomaly"] for r in isolation.iforest_score(same, "id", ["a", "b"], None, 5, 64).collect()} == {None}
    assert isolation.iforest_score(df.limit(0), "id", ["a", "b"], None, 5, 64).count() == 0


# ---- T29 ----
def sequential(points):
    """Pooling one point after the other; (score, value) per distinct score."""
    by = {}
    for p, y in points:
        by.setdefault(p, []).append(y)
    out = []
    for p in sorted(by):
        out.append([[p], sum(by[p]), len(by[p])])
        while len(out) > 1 and out[-2][1] / out[-2][2] >= out[-1][1] / out[-1][2]:
            last = out.pop()
            out[-1] = [out[-1][0] + last[0], out[-1][1] + last[1], out[-1][2] + last[2]]
    return [(p, s / n) for ps, s, n in out for p in ps]


@pytest.mark.parametrize("kind", ["noisy", "ties", "constant", "falling", "rising"])
def test_isotonic_equals_a_sequential_fit(spark, kind):
    rnd = np.random.default_rng(2)
    p = np.round(rnd.random(3000), 1 if kind == "ties" else 4)
    y = {"noisy": rnd.random(3000) < p, "ties": rnd.random(3000) < p, "constant": np.ones(3000), "falling": 1 - p > rnd.random(3000), "rising": p > 0.5}[kind]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(p, y)] + [(None, 1.0), (0.3, None)], "p double, y double")
    model = isotonic.fit_isotonic(df, "p", "y").collect()
    want = sequential(zip(p.tolist(), y.astype(float).tolist()))
    of = {a: r["value"] for r in model for a, _ in want if r["lo"] <= a <= r["hi"]}
    assert [of[a] for a, _ in want] == pytest.approx([v for _, v in want], abs=1e-12)
    assert len(model) == len({round(v, 12) for _, v in want})


def test_isotonic_scores_between_and_beyond_blocks(spark):
    df = spark.createDataFrame([(0.2, 0.0), (0.4, 0.0), (0.6, 1.0), (0.6, 0.0), (0.9, 1.0)], "_x double, y double")
    model = isotonic.fit_isotonic(df, "_x", "y")
    asked = spark.createDataFrame([(x,) for x in (0.1, 0.3, 0.5, 0.6, 0.75, 0.9, 5.0, None)], "p double")
    got = [r["p_cal"] for r in isotonic.apply_isotonic(model, asked, "p", eps=0.001).orderBy("p").collect()]
    assert got[0] is None and got[1:] == pytest.approx([0.001, 0.001, 0.25, 0.5, 0.75, 0.999, 0.999])


# ---- N38, N23 ----
def test_singular_values_equal_an_exact_svd(spark):
    rnd = np.random.default_rng(3)
    docs = [(i, [f"t{min(int(z), 60)}" for z in rnd.zipf(1.5, 25)] + [f"only{i}"]) for i in range(70)] + [(70, [])]
    df = spark.createDataFrame(docs, "doc_id bigint, tokens array<string>")
    tf = textops.term_counts(df, "doc_id")
    n = df.agg(F.count(F.lit(1))).scalar()
    cells = factor.tfidf_cells(tf, "doc_id", n)
    rows = cells.collect()
    names = sorted({r["term"] for r in rows})
    a = np.zeros((71, len(names)))
    for r in rows:
        a[r["doc_id"], names.index(r["term"])] = r["w"]
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    values, vectors = factor.lsa(tf, df, "doc_id", n, 6)
    assert values == pytest.approx(s[:6], rel=1e-5)
    got = {r["doc_id"]: np.array(r["vector"]) for r in vectors.collect()}
    assert len(got) == 71 and not got[70].any()
    want = u[:, :6] * s[:6]
    cos = lambda m, i, j: m[i] @ m[j] / np.linalg.norm(m[i]) / np.linalg.norm(m[j])
    assert all(abs(got[i] @ got[j] - cos(want, i, j)) < 1e-3 for i, j in ((0, 1), (5, 9), (20, 40)))
    assert len(names) > 60  # no term is left out


def test_products_of_blocks_and_slices(spark, monkeypatch):
    """Several blocks of documents; terms of one document are numbers on the diagonal and meet nothing."""
    monkeypatch.setattr(factor, "CELLS", 60)
    rnd = np.random.default_rng(5)
    a = np.where(rnd.random((50, 30)) < 0.2, rnd.random((50, 30)), 0.0)
    lone = rnd.random(50)
    rows = [(f"d{i}", f"t{j}", float(a[i, j])) for i, j in zip(*np.nonzero(a))] + [(f"d{i}", f"only{i}", float(x)) for i, x in enumerate(lone)]
    cells = spark.createDataFrame(rows, "doc string, term string, w double")
    s = np.linalg.svd(np.hstack([a, np.diag(lone)]), compute_uv=False)
    values, got = factor.truncated_svd(cells, "doc", 4)
    assert values == pytest.approx(s[:4], rel=1e-4)
    assert got.count() == 50
    blocks, places = factor.pack(cells, "doc", 6, 3)
    terms = {x for r in blocks.collect() for x in np.frombuffer(r["terms"], np.int64).tolist()}
    assert len(terms) == int(((a > 0).sum(axis=0) > 1).sum()) and blocks.count() == 3 and places.count() == 50


def test_vectors_from_tokens_leave_no_steps_behind(spark, monkeypatch):
    """Two documents a block, one block a group: the same decomposition, and only its result stays on disk."""
    monkeypatch.setattr(factor, "CELLS", 60)
    monkeypatch.setattr(factor, "GROUP", 1)
    rnd = np.random.default_rng(8)
    docs = [(f"d{i}", " ".join([f"t{'abcdefghij'[min(int(z), 10) - 1]}" for z in rnd.zipf(1.5, 20)] + [f"only_{'x' * (i + 1)}"])) for i in range(12)] + [("d12", ""), ("d13", None)]
    df = spark.createDataFrame(docs, "doc_id string, text string")
    cells = factor.tfidf_cells(textops.term_counts(textops.tokens_of(df, "doc_id", "text"), "doc_id"), "doc_id", df.agg(F.count(F.lit(1))).scalar()).collect()
    names = sorted({r["term"] for r in cells})
    a = np.zeros((14, len(names)))
    for r in cells:
        a[int(r["doc_id"][1:]), names.index(r["term"])] = r["w"]
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    before = set(os.listdir(shared_dir(spark)))
    values, got = factor.lsa_tokens(df, "doc_id", textops.tokenize("text"), F.length("text") / 4, 4)
    assert values == pytest.approx(s[:4], rel=1e-5)
    left = [x for x in os.listdir(shared_dir(spark)) if x not in before and any(f.startswith("part-") for _, _, fs in os.walk(f"{shared_dir(spark)}/{x}") for f in fs)]
    assert len(left) == 1
    v = {r["doc_id"]: np.array(r["vector"]) for r in got.collect()}
    assert len(v) == 14 and not v["d12"].any() and not v["d13"].any()
    want = u[:, :4] * s[:4]
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-12)
    assert all(abs(v[f"d{i}"] @ v[f"d{j}"] - want[i] @ want[j]) < 1e-3 for i in range(12) for j in range(i))
    monkeypatch.setattr(factor, "CELLS", 10**6)
    whole, _ = factor.lsa_tokens(df, "doc_id", textops.tokenize("text"), F.length("text"), 4, rounds=1)
    assert whole == pytest.approx(s[:4], rel=1e-3)  # rounds that end before the values settle


def test_clusters_have_stable_names(spark):
    rows = [(i, [1.0, 0.1 * (i % 3)] if i % 2 else [0.1 * (i % 5), 1.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, vector array<double>")
    got = {r["doc_id"]: r["class_label"] for r in models.cluster_taxonomy(df, "doc_id", "vector", 2).collect()}
    assert got == {i: "cluster_1" if i % 2 == 0 else "cluster_2" for i in range(40)}
    assert got == {r["doc_id"]: r["class_label"] for r in models.cluster_taxonomy(df.repartition(3), "doc_id", "vector", 2).collect()}


# ---- N17 ----
def test_topics_keep_no_vocabulary_in_the_plan(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, [f"a{x}" if i % 2 else f"b{x}" for x in rnd.integers(0, 30, 40)]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, tokens array<string>")
    model = models.lda(df, "doc_id", "tokens", 2)
    words = models.top_words(model, 5)
    assert "a1" not in words._jdf.queryExecution().analyzed().toString().replace("LocalRelation", "") or model.n_terms == 60
    plan = words._jdf.queryExecution().optimizedPlan().toString()
    assert not any(f"b{x}," in plan for x in range(30))
    by = {}
    for r in words.collect():
        by.setdefault(r["topic"], set()).add(r["term"][0])
    assert sorted(map(sorted, by.values())) == [["a"], ["b"]]
    new = spark.createDataFrame([(1, ["a1", "a2", "unknown"]), (2, ["b3", "b3"]), (3, ["unknown"]), (4, [])], "doc_id bigint, tokens array<string>")
    got = {r["doc_id"]: r["topic"] for r in models.allocate(model, new, "doc_id").collect()}
    assert got[1] != got[2] and len(got) == 4


# ---- N30, J13, T20 ----
def test_index_loses_no_row_of_the_top(spark):
    rnd = np.random.default_rng(5)
    word = lambda n: [f"w{min(int(z), 300)}" for z in rnd.zipf(1.4, n)]
    docs = spark.createDataFrame([(i, word(int(rnd.integers(3, 60)))) for i in range(700)] + [(700 + i, ["w1", "w2", "w7"]) for i in range(40)], "doc_id bigint, tokens array<string>")
    items = spark.createDataFrame([(i, word(12)) for i in range(30)], "item_id bigint, tokens array<string>")
    c, q = textops.term_counts(docs, "doc_id").cache(), textops.term_counts(items, "item_id").cache()
    n = docs.agg(F.count(F.lit(1))).scalar()
    idx = index.bm25_index(c, "doc_id", n, block=16)
    got = sorted(tuple(r) for r in index.search_index(idx, q, "item_id", "doc_id", 5, probe=2).collect())
    every = idx.select("term", F.explode("docs").alias("d")).join(q, "term").groupBy("item_id", F.col("d.id").alias("doc_id")).agg(
        F.round(F.sum(F.col("tf") * F.col("d.add")), 9).alias("score")).collect()
    want = []
    for i in {r["item_id"] for r in every}:
        best = sorted(((-r["score"], r["doc_id"]) for r in every if r["item_id"] == i))[:5]
        want += [(i, d, -s, k) for k, (s, d) in enumerate(best, 1)]
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in sorted(want)]


def test_buckets_reach_most_neighbours(spark):
    rnd = np.random.default_rng(6)
    centre = rnd.standard_normal((40, 32))
    v = centre[rnd.integers(0, 40, 1500)] + 0.4 * rnd.standard_normal((1500, 32))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(9999, None)], "id bigint, v array<double>")
    q = df.where("id % 10 = 0").withColumnRenamed("id", "q")
    plan = lambda d: {(r["q"], r["id"]): r["score"] for r in d.collect()}
    exact = plan(nearest.block_topk(q.where("v is not null"), df.where("v is not null"), "q", "id", "v", 10))
    found = plan(nearest.lsh_topk(q, df, "q", "id", "v", 10, slice_rows=40))
    hits = exact.keys() & found.keys()
    assert len(hits) >= 0.9 * len(exact) and all(abs(exact[h] - found[h]) < 1e-9 for h in hits)


def test_few_centres_move_no_points(spark):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(50)] + [(99, None)], "id bigint, v array<double>")
    c = spark.createDataFrame([(5, [0.0, 1.0]), (2, [6.0, 1.0]), (3, [6.0, 1.0])], "c bigint, v array<double>")
    for metric in ("cosine", "l2"):
        near = nearest.center_topk(df, c, "id", "c", "v", 2, metric)
        assert "CoGroup" not in near._jdf.queryExecution().executedPlan().toString()
        far = nearest.center_topk(df.where("v is not null"), c, "id", "c", "v", 2, metric, limit=0)
        assert "CoGroup" in far._jdf.queryExecution().executedPlan().toString()
        key = lambda d: sorted((r["id"], r["c"], round(r["score"], 9), r["rank"]) for r in d.collect())
        assert key(near) == key(far)
    many = [retrieval.assign(df, "id", "v", c.withColumnRenamed("v", "centroid"), "c")]
    assert "CoGroup" not in many[0]._jdf.queryExecution().executedPlan().toString()
