"""Topics in slices, several models side by side."""

import math

import numpy as np
from pyspark.sql import functions as F

from tidewake.operators import index, textops, topics


def test_a_block_is_fitted_as_its_documents_one_by_one():
    rnd = np.random.default_rng(1)
    beta, alpha = rnd.gamma(1.0, 1.0, (12, 3)), np.array([0.3, 0.2, 0.5])
    docs = [np.sort(rnd.choice(12, n, replace=False)) for n in (5, 0, 1, 9)]
    ends, cols = np.cumsum([0, *map(len, docs)]), np.concatenate(docs)
    n = rnd.integers(1, 9, len(cols)).astype(float)
    gamma, sums = topics.infer(ends, cols, n, beta, alpha)
    want = np.zeros(beta.shape)
    for d, (a, z) in enumerate(zip(ends, ends[1:])):
        g = np.ones(3)
        for _ in range(5000 if z > a else 0):
            t = np.exp(topics.digamma(g) - topics.digamma(g.sum()))
            g = alpha + t * (beta[cols[a:z]] * (n[a:z] / (beta[cols[a:z]] @ t))[:, None]).sum(0)
        if z > a:
            t = np.exp(topics.digamma(g) - topics.digamma(g.sum()))
            want[cols[a:z]] += (n[a:z] / (beta[cols[a:z]] @ t))[:, None] * t
        assert np.allclose(gamma[d], g if z > a else 0, atol=0.2)
    assert np.allclose(sums, want, rtol=0.1, atol=0.2)
    assert abs(topics.digamma(np.array(1.0)) + 0.5772156649) < 1e-9 and abs(topics.trigamma(np.array(1.0)) - math.pi**2 / 6) < 1e-9


def test_models_side_by_side_send_only_totals(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, [f"a{x}" if i % 2 else f"b{x}" for x in rnd.integers(0, 30, 40)]) for i in range(60)] + [(60, []), (61, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, tokens array<string>")
    model = topics.fit_topics(df, "doc_id", "tokens", [2, 3], turns=6)
    t = model.topics
    assert t.totals.shape == (5,) and t.lam.count() == t.slices  # the weights of the terms are a table
    assert not any(isinstance(x, np.ndarray) and x.size > t.width for x in vars(t).values())
    words = topics.best_terms(model, 4).collect()
    assert len(words) == 4 * 5 and {(r["model"], r["topic"]) for r in words} == {(0, 0), (0, 1), (1, 0), (1, 1), (1, 2)}
    got = {r["doc_id"]: r["mixtures"] for r in model.transform(df, "doc_id", "tokens").collect()}
    assert len(got) == 62 and got[60] == got[61] == [[0, 0], [0, 0, 0]]
    assert all(abs(sum(x) - 1) < 1e-6 for i in range(60) for x in got[i])


def test_every_block_has_a_turn(spark):
    counted = topics.count_blocks(spark.range(90).select(F.col("id").alias("doc_id"), F.array(F.lit("a")).alias("tokens")), "doc_id", "tokens", 30)
    placed = topics.place(counted, spark.createDataFrame([("a", 0, 90)], "term string, id int, df bigint"), 1, None, 4, turns=3)
    assert placed.where("_turn < 3").count() == counted.count() and placed.select("_turn").distinct().count() == 3


# ---- N30, N33 ----
def test_counts_of_blocks_make_the_same_index(spark):
    rnd = np.random.default_rng(5)
    word = lambda n: [f"w{min(int(z), 60)}" for z in rnd.zipf(1.4, n)]
    docs = spark.createDataFrame([(i, word(int(rnd.integers(1, 40)))) for i in range(200)] + [(200, None), (201, [])], "doc_id bigint, tokens array<string>")
    n, tf = docs.agg(F.count(F.lit(1))).scalar(), textops.term_counts(docs, "doc_id").cache()
    counted = index.count_index(docs, "doc_id", "tokens", n, block=16)
    wanted = tf.select("term").distinct().where("term <> 'w3'")
    flat = lambda d: {(r["term"], r["block"]): (round(r["top"], 9), [(x["id"], round(x["add"], 9)) for x in r["docs"]]) for r in d.where("term <> 'w3'").collect()}
    assert flat(index.bm25_counts(counted, index.frequencies(counted), wanted, n)) == flat(index.bm25_index(tf, "doc_id", n, block=16))
    assert flat(index.match_counts(counted, wanted)) == flat(index.match_index(tf, "doc_id", n, block=16))
