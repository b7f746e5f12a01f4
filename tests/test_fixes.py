"""Operators on ids of any type, small samples and large means."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.operators import aggregate, cluster, joins, nearest, series, strategy, timeline


def test_neighbours_keep_string_ids(spark):
    d = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [0.9, 0.1]), ("c", [0.0, 1.0])], "id string, v array<double>")
    got = nearest.block_topk(d, d, "id", "id", "v", 1, exclude_self=True).collect()
    assert {(r["id"], r["id_base"]) for r in got} == {("b", "a"), ("a", "b"), ("c", "a")}


def test_asof_follows_all_order_columns(spark):
    left = spark.createDataFrame([("k", 10)], "k string, sec bigint")
    right = spark.createDataFrame([("k", 5, "a", 2, 1.0), ("k", 5, "b", 1, 2.0), ("k", 5, "b", 3, 3.0)], "k string, sec bigint, o1 string, o2 int, p double")
    assert joins.asof_backward(left, right, "k", "sec", "p", ["o1", "o2"]).first()["asof"] == 3.0


@pytest.mark.parametrize("dof, want", [(1, 12.706205), (2, 4.302653), (3, 3.182446), (10, 2.228139), (11, 2.200985), (30, 2.042272)])
def test_student_quantiles(spark, dof, want):
    got = spark.range(1).select(aggregate.t_quantile_975(F.lit(dof)).alias("t")).first()["t"]
    assert got == pytest.approx(want, abs=2e-5)


def test_rolling_deviation_of_large_means(spark):
    rows = [("k", s, 1e8 + s % 2) for s in range(200)]
    d = spark.createDataFrame(rows, "k string, sec bigint, v double")
    got = timeline.rolling(d, "k", "sec", {"s": (20, "std", F.col("v"))}).where("sec = 150").first()["s"]
    assert got == pytest.approx(math.sqrt(20 * 0.25 / 19), rel=1e-9)


def test_long_chain_is_one_component(spark):
    n = 150
    nodes = spark.range(n).withColumnRenamed("id", "node")
    edges = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert cluster.connected_components(edges, nodes).select("component").distinct().count() == 1


def test_more_shuffle_partitions_mean_smaller_buckets(spark):
    from tidewake.operators import ordering
    d = spark.range(20_000).select((F.col("id") % 997).cast("double").alias("v"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        cuts = ordering.cut_points(d, "v")
        sizes = [r["count"] for r in d.distinct().groupBy(ordering.bucket_of(F.col("v"), cuts)).count().collect()]
        assert len(cuts) > 200 and max(sizes) <= 20
        assert ordering.quantiles(d, "v", [0.5]).first()[0] == d.selectExpr("percentile(v, 0.5)").first()[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_tree_tables_and_text_svm(spark):
    from tidewake.operators import models as m
    d = spark.createDataFrame([(i, float(i % 10), float(i % 3), int(i % 10 > 4)) for i in range(200)], "id bigint, a double, b double, y int")
    rules = m.tree_rules(spark, m.fit_tree(d, ["a", "b"], "y", 3), ["a", "b"]).collect()
    assert any("(a <=" in r["rule"] for r in rules) and not any("feature" in r["rule"] for r in rules)
    imp = {r["column"]: r["importance"] for r in m.importances(spark, m.fit_forest(d, ["a", "b"], "y", 10, 3), ["a", "b"]).collect()}
    assert imp["a"] > 0.9 and sum(imp.values()) == pytest.approx(1.0)
    t = spark.createDataFrame([(i, ["good", "fine", f"w{i % 7}"] if i % 2 else ["bad", "poor", f"w{i % 7}"], i % 2) for i in range(60)], "id int, tokens array<string>, y int")
    assert m.score(m.fit_text_svm(t, "tokens", "y"), t, ["y"]).where("prediction <> y").count() == 0


def test_dickey_fuller_of_large_levels(spark):
    v = np.random.default_rng(3).normal(size=80).cumsum()
    got = []
    for level, scale in ((0.0, 1.0), (2e9, 1e7)):
        d = spark.createDataFrame([("k", i, float(level + scale * x)) for i, x in enumerate(v)], "k string, t int, v double")
        got.append(series.adf(d, "k", "t", "v", 1, "trend").first()["adf"])
    assert got[1] == pytest.approx(got[0], rel=1e-6)


def test_kelly_growth_beyond_the_doubles(spark):
    d = spark.range(20_000).select("id", F.col("id").alias("sec"), F.lit(0.9).alias("p"), F.lit(0.5).alias("pm"), F.lit(1).alias("y"))
    got = strategy.kelly_compound(d, "p", "pm", "y", "sec", ["sec", "id"], 0.1).first()
    assert got["log_growth"] == pytest.approx(20_000 * math.log(1.05), rel=1e-9)
