"""Hand-computed checks of joins, metrics, text, clustering, series and streams."""

import math
import random
import tempfile
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewake.functions import scalars as s, text as tx
from tidewake.operators import cluster, evaluate, isolation, joins, models, nearest, ordering, ranking, retrieval, sampling, series, strategy, textops
from tidewake.streaming import streams


def col(df, c):
    return [r[c] for r in df.collect()]


def test_deadlines_and_numbers(spark):
    d = spark.createDataFrame([("Strike by March 7, 2025?",), ("by february 30",), ("by June 3",), ("none",)], "q string")
    got = [str(x) if x else None for x in col(d.select(s.parse_deadline("q", 2026).alias("d")), "d")]
    assert got == ["2025-03-07", None, "2026-06-03", None]
    n = spark.createDataFrame([("12,348,730",), (".238.00",), ("132.89B",), ("+13.56",), ("x",)], "t string")
    got = col(n.select(s.parse_number("t").alias("v")), "v")
    assert got[4] is None and np.allclose(got[:4], [12348730.0, 238.0, 132.89e9, 13.56])


def test_winning_side(spark):
    d = spark.createDataFrame([("['1', '0']", None, None), ('["0.0","1.0"]', None, None), (None, 10, 10), (None, 10, 11), (None, None, 1)],
                              "p string, d bigint, e bigint")
    assert col(d.select(s.winning_side("p", "d", "e").alias("x")), "x") == [0, 1, 0, 1, None]


def test_asof_is_strict_and_falls_back(spark):
    left = spark.createDataFrame([("a", 10, 1, 0.9), ("a", 11, 2, 0.8), ("b", 5, 3, 0.7)], "k string, sec bigint, id bigint, price double")
    right = spark.createDataFrame([("a", 10, 1, 0.1), ("a", 3, 2, 0.2)], "k string, sec bigint, id bigint, q double")
    d = joins.asof_backward(left, right, "k", "sec", "q", "id", "quote", fallback=F.col("price"))
    assert {r.id: r.quote for r in d.collect()} == {1: 0.2, 2: 0.1, 3: 0.7}


def test_range_join_matches_brute_force(spark):
    rng = random.Random(1)
    p = [(rng.choice("ab"), rng.randrange(500), i) for i in range(200)]
    iv = [(rng.choice("ab"), lo, lo + rng.randrange(60), i) for i, lo in enumerate(rng.randrange(500) for _ in range(60))]
    d = joins.range_join(spark.createDataFrame(p, "k string, at bigint, pid bigint"),
                         spark.createDataFrame(iv, "k string, lo bigint, hi bigint, iid bigint"), "k", "at", "lo", "hi", 50)
    want = {(i, j) for k, at, i in p for k2, lo, hi, j in iv if k == k2 and lo <= at < hi}
    assert {(r.pid, r.iid) for r in d.collect()} == want


def test_exact_quantiles_and_cut(spark):
    rng = random.Random(2)
    vals = [float(rng.choice([1, 2, 2, 3, rng.randrange(1000)])) for _ in range(999)]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id bigint, v double")
    row = ordering.quantiles(d, "v", [0.0, 0.1, 0.5, 0.99, 1.0]).first()
    assert np.allclose(list(row), np.quantile(vals, [0, 0.1, 0.5, 0.99, 1.0]))
    got = {r.id for r in ranking.top_fraction(d, "v", 0.3, "id").collect()}
    want = {i for i, _ in sorted(enumerate(vals), key=lambda x: (-x[1], x[0]))[: int(999 * 0.3)]}
    assert got == want


def test_auc_ties_and_one_class(spark):
    d = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.5), ("a", 1, 0.9), ("b", 1, 0.2)], "g string, y int, p double")
    got = {r.g: r.auc for r in evaluate.auc(d, "y", "p", "g").collect()}
    assert got["a"] == 0.75 and got["b"] is None


def test_ece_puts_one_in_the_last_bin(spark):
    d = spark.createDataFrame([(1, 1.0), (0, 0.0), (1, 0.95)], "y int, p double")
    assert {r.bin for r in evaluate.reliability(d, "y", "p").collect()} == {0, 9}


def test_max_drawdown_over_slices(spark):
    rng = random.Random(3)
    steps = [rng.uniform(-1, 1) for _ in range(500)]
    d = spark.createDataFrame([(i * 37, i, x) for i, x in enumerate(steps)], "sec bigint, id bigint, x double")
    row = strategy.path_extremes(d, None, "sec", ["sec", "id"], "x", 600).first()
    cum = np.cumsum(steps)
    assert math.isclose(row.max_drawdown, (np.maximum.accumulate(cum) - cum).max(), abs_tol=1e-9)
    assert math.isclose(row.lowest, cum.min(), abs_tol=1e-9) and math.isclose(row.total, cum[-1], abs_tol=1e-9)


def test_nearest_over_many_blocks(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4))
    d = spark.createDataFrame([(i, [float(z) for z in v]) for i, v in enumerate(x)], "b bigint, v array<double>")
    got = nearest.block_topk(d.withColumnRenamed("b", "q"), d, "q", "b", "v", 3, "l2", q_block=16, b_slice=13, exclude_self=True)
    dist = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(dist, np.inf)
    want = {(i, int(j)) for i in range(60) for j in np.argsort(dist[i])[:3]}
    assert {(r.q, r.b) for r in got.collect()} == want


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_meetings_score_few_pairs_at_once(metric):
    """Every row of a large meeting gets its exact neighbours, ties to the smaller id, within a tenth of the product matrix."""
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(3000, 8)), rng.normal(size=(12_000, 8))
    y[5000:9000] = y[0]
    x[:20] = y[0]
    side = lambda v: pa.table({"_id": np.arange(len(v)), "_v": pa.array(list(v))})
    tracemalloc.start()
    got = nearest._meeting(5, metric, False)(side(x), side(y))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3000 * 12_000 * 8 / 4
    xy, xx, yy = x[:200] @ y.T, (x[:200] ** 2).sum(1)[:, None], (y**2).sum(1)
    s = np.round(xy / np.sqrt(xx * yy) if metric == "cosine" else 2 * xy - xx - yy, 11)
    want = np.argsort(-s, axis=1, kind="stable")[:, :5]
    assert (got["b"].to_numpy().reshape(3000, 5)[:200] == want).all()
    assert np.allclose(got["score"].to_numpy().reshape(3000, 5)[:200], np.take_along_axis(s, want, axis=1), atol=1e-10)


def test_restricted_meetings_are_cut_by_group(spark):
    """A base row is copied to the blocks of its own group's queries only."""
    d = spark.range(200).select("id", (F.col("id") % 10).alias("g"), F.array(F.col("id") * 1.0, F.lit(1.0)).alias("v"))
    near = nearest.block_topk(d.withColumnRenamed("id", "q"), d, "q", "id", "v", 1, "l2", restrict="g", q_block=20, b_slice=20)
    assert {(r["q"], r["id"]) for r in near.collect()} == {(i, i) for i in range(200)}
    sizes = nearest.group_parts(d.select(F.col("g").alias("_g")), d.select(F.col("g").alias("_g")), 20, 20).collect()
    assert len(sizes) == 10 and all((r["_blks"], r["_slcs"]) == (1, 1) for r in sizes)


def test_tfidf_by_blocks_sends_terms_not_counts(spark):
    """Weights of token lists over many blocks are those of the long form; only terms of two blocks and more come back."""
    rng = random.Random(4)
    lists = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 30))] for _ in range(80)] + [["only", "here", "only"], None, ["a b", "a", "b"]]
    d = spark.createDataFrame([(i % 82, i % 2, x) for i, x in enumerate(lists)], "id int, side int, tokens array<string>")
    d = d.withColumn("both", F.array(F.lit(1), F.lit(2)))
    n_docs = d.agg(F.count(F.lit(1))).scalar()
    for pairs in (False, True):
        long = textops.term_counts(textops.add_bigram_tokens(d) if pairs else d, "id")
        key = lambda x: sorted((r["id"], r["term"], r["tf"], r["df"], round(r["weight"], 12)) for r in x.collect())
        got = textops.token_tfidf(d, "id", n_docs, pairs=pairs, block=10)
        assert key(got) == key(textops.tfidf(long, "id", n_docs)) and len({r["term"] for r in got.collect()}) > 10
    some = textops.token_tfidf(d, "id", n_docs, keep=["side", "both"], rows=F.col("id") < 5, block=10).collect()
    assert {r["id"] for r in some} <= set(range(5)) and all((r["side"], r["both"]) == (r["id"] % 2, [1, 2]) for r in some if r["id"])
    assert {(r["term"], r["df"]) for r in some} <= {(r["term"], r["df"]) for r in textops.tfidf(textops.term_counts(d, "id"), "id", n_docs).collect()}


def test_only_keywords_become_rows(spark):
    d = spark.createDataFrame([(1, ["a", "x", "a"]), (1, ["a", "b"]), (2, ["y"]), (3, None)], "id int, tokens array<string>")
    k = spark.createDataFrame([("p", "a", 1), ("q", "b", 1), ("q", "a", 2)], "label string, term string, rank bigint")
    got = retrieval.keyword_terms(d, "id", "tokens", k)
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (1, "b")]
    gold = spark.createDataFrame([(1, "q"), (2, "p")], "id int, label string")
    curve = retrieval.precision_curve(got, "id", k, "label", gold, "label", [1, 2])
    assert sorted((r["n"], r["precision_macro"]) for r in curve.collect()) == [(1, 0.0), (2, 0.5)]


def test_bernoulli_predicts_from_token_lists(spark):
    """Blocks of token lists give the prediction of the long form, for documents without known terms as well."""
    rng = random.Random(5)
    d = spark.createDataFrame([(i % 58, i % 3, [rng.choice("abcdefgh") for _ in range(rng.randint(0, 9))]) for i in range(60)] + [(90, 0, None)], "id int, y int, tokens array<string>")
    model = textops.bernoulli_nb(textops.term_counts(d.where("id < 20"), "id", keep=["y"]), "id", "y")
    every = d.unionByName(spark.createDataFrame([(91, 0, ["zz"]), (92, 0, ["zz", "a", "a"])], d.schema))
    key = lambda x: sorted((r["id"], r["prediction"], round(r["log_posterior"], 9)) for r in x.collect())
    got = key(textops.bernoulli_nb_predict_tokens(model, every, "id", "y", every.agg(F.count(F.lit(1))).scalar(), block=7))
    assert got == key(textops.bernoulli_nb_predict(model, textops.term_counts(every, "id"), "id", "y")) and 92 in {g[0] for g in got} and 91 not in {g[0] for g in got}


def naive_dbscan(x, eps, m):
    d = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps
    core = d.sum(1) >= m
    comp = np.arange(len(x))
    changed = True
    while changed:
        changed = False
        for i in np.flatnonzero(core):
            low = comp[np.flatnonzero(d[i] & core)].min()
            if low < comp[i]:
                comp[i], changed = low, True
    return [int(comp[i]) if core[i] else int(comp[np.flatnonzero(d[i] & core)].min()) if (d[i] & core).any() else -1 for i in range(len(x))]


def test_dbscan_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(c, 0.4, size=(60, 2)) for c in ((0, 0), (3, 0), (1.5, 2.5))] + [rng.uniform(-3, 6, size=(40, 2))])
    d = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id bigint, x double, y double")
    got = {r.id: r.cluster for r in cluster.dbscan(d, "id", ["x", "y"], 0.4, 5).collect()}
    assert [got[i] for i in range(len(x))] == naive_dbscan(x, 0.4, 5)


def test_similar_items_over_blocks(spark):
    rng = random.Random(6)
    rows = [(u, i, float(rng.randrange(1, 6))) for u in range(40) for i in range(12) if rng.random() < 0.7]
    d = spark.createDataFrame(rows, "u bigint, i bigint, v double")
    got = {(r.i, r.similar_i): (r.n, r.corr) for r in cluster.similar_items(d, "u", "i", "v", 5, 100, block=4, users_per_slice=10).collect()}
    m = {(u, i): v for u, i, v in rows}
    for a in range(12):
        for b in range(12):
            us = [u for u in range(40) if (u, a) in m and (u, b) in m]
            if a != b and len(us) >= 5:
                c = np.corrcoef([m[u, a] for u in us], [m[u, b] for u in us])[0, 1]
                assert got[a, b][0] == len(us) and math.isclose(got[a, b][1], c, abs_tol=1e-8)


def test_similar_items_of_light_and_heavy_users(spark):
    """Pairs of light users and block sums of heavy ones add up; few copies are made where items fill many blocks."""
    rng = random.Random(7)
    rows = [(u, i, float(rng.randrange(1, 6))) for u in range(40) for i in range(12) if rng.random() < (0.9 if u % 3 else 0.4)]
    d = spark.createDataFrame(rows, "u bigint, i bigint, v double")
    runs = [sorted(tuple(r) for r in cluster.similar_items(d, "u", "i", "v", 5, 100, block=4, users_per_slice=10, heavy=h).collect()) for h in (0, 6, 512)]
    assert len(runs[0]) == 132 and runs[0] == runs[1] == runs[2]


def test_iforest_ranks_an_outlier_first(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, size=(500, 2)), [[9, 9]]])
    d = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id bigint, x double, y double")
    out = isolation.iforest_score(d, "id", ["x", "y"], n_trees=20, sample=64)
    assert out.orderBy(F.col("anomaly").desc()).first().id == 500


def test_permuted_column_is_a_permutation(spark):
    d = spark.createDataFrame([(i, float(i)) for i in range(200)], "id bigint, v double")
    got = models.permuted(d, "id", "v", 1).collect()
    assert sorted(r.v for r in got) == [float(i) for i in range(200)]
    assert sum(r.v != r.id for r in got) > 150


def test_bootstrap_weights_have_mean_one(spark):
    d = spark.range(20000).select(sampling.poisson_weight(s.unit_hash("id", seed=3)).alias("w"))
    assert abs(d.agg(F.avg("w")).first()[0] - 1) < 0.03


def test_chunk_markdown(spark):
    text = "# Title\n\nalpha beta\n\ngamma delta\n## Next\n### Deeper\nwords here now\n## Tail"
    d = spark.createDataFrame([(1, text)], "id bigint, text string")
    got = textops.chunk_markdown(d, "id", "text", 3).orderBy("chunk_no").collect()
    assert [r.chunk_text for r in got] == ["# Title\n\nalpha beta", "gamma delta", "## Next\n### Deeper\nwords here now\n## Tail"]
    assert got[0].headings == ["Title"] and [r.heading_only for r in got] == [0, 0, 0]


def test_refine_docs(spark):
    text = "Head\n====\nbody\r\n\n\n\n\n#tight\n# Second\n```\n# code\n```\n"
    d = spark.createDataFrame([(1, text, "fallback"), (2, "plain", "fallback")], "id bigint, text string, title string")
    r = textops.refine_docs(d, "id", "text", "title")
    got = {x.id: x for x in r.collect()}
    assert got[1].refined == "# Head\nbody\n\n\n## tight\n## Second\n```\n# code\n```\n"
    assert got[2].refined == "# fallback\n\nplain\n" and got[2].actions == ["inserted_missing_h1"]
    f = {x.id: x.flags for x in textops.doc_flags(r, "id").collect()}
    assert "multiple_h1_before_refine" in f[1] and "missing_h1_before_refine" in f[2]


def test_text_rules(spark):
    d = spark.createDataFrame([("Fix TAX-12 in ONE STREAM http://a.b [Redacted Name] now.Then",)], "t string")
    row = d.select(tx.apply_rules("t", tx.ID_RULES + tx.TYPO_RULES).alias("a"), tx.normalise_text("t").alias("b")).first()
    assert row.a.startswith("Fix tax_code in onestream") and row.b == "fix tax-12 in one stream now. then"


def test_ets_holt_matches_a_plain_loop(spark):
    rng = np.random.default_rng(1)
    y = np.cumsum(rng.normal(1, 2, 40)) + 50
    d = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(y)], "k string, t int, v double")
    row = series.ets(d, "k", "t", "v", "holt", 2, alphas=(0.3,), betas=(0.2,)).orderBy("h").collect()
    l, b, sse = y[0], y[1] - y[0], 0.0
    for v in y[1:]:
        sse += (v - l - b) ** 2
        nl = 0.3 * v + 0.7 * (l + b)
        b = 0.2 * (nl - l) + 0.8 * b
        l = nl
    assert math.isclose(row[0].sse, sse, rel_tol=1e-9) and math.isclose(row[1].forecast, l + 2 * b, rel_tol=1e-9)


def test_grouped_ols_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 2))
    y = 1 + x @ [2, -3] + rng.normal(size=50) * 0.1
    d = spark.createDataFrame([("g", float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "k string, a double, b double, y double")
    got = {r.term: r.beta for r in series.grouped_ols(d, "k", F.col("y"), {"a": F.col("a"), "b": F.col("b")}).collect()}
    want = np.linalg.lstsq(np.column_stack([np.ones(50), x]), y, rcond=None)[0]
    assert np.allclose([got["(intercept)"], got["a"], got["b"]], want)


def test_student_quantiles_and_chi2(spark):
    from tidewake.operators.aggregate import t_quantile_975

    d = spark.range(1).select(t_quantile_975(F.lit(10)).alias("t"), series.chi2_sf(F.lit(18.307), 10).alias("p"), series.chi2_sf(F.lit(3.841459), 1).alias("q"))
    r = d.first()
    assert abs(r.t - 2.2281) < 1e-3 and abs(r.p - 0.05) < 1e-4 and abs(r.q - 0.05) < 1e-5


def test_stream_resumes_from_its_checkpoint(spark):
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    src, out, ck = f"{base}/in", f"{base}/out", f"{base}/ck"
    spark.range(0, 10).write.parquet(src)
    assert streams.run_available(streams.ingest_stream(spark, src, "id bigint"), out, ck).count() == 10
    spark.range(10, 15).write.mode("append").parquet(src)
    assert streams.run_available(streams.ingest_stream(spark, src, "id bigint"), out, ck).count() == 15


def test_time_bounds_reach_the_scan(spark):
    from tidewake.sources.readers import scan_trades

    ids = spark.createDataFrame([(1,)], "l_suppkey bigint")
    d = scan_trades(spark, "/root/testdata/sf0.001/lineitem.parquet", ids, "l_suppkey", "l_orderkey", 10, 20, ["l_orderkey", "l_suppkey"])
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_orderkey,10)" in plan and "l_quantity" not in plan
