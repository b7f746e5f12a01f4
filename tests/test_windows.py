"""Row-ordered and time-windowed features on hand-made frames: ties, interleaved keys, edges, skew."""

import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewake.operators import windows as w
from tidewake.operators.timeline import prior, rolling

ORDER = ("sec", "id")


def frame(spark, rows, schema="k string, sec bigint, id bigint, v double"):
    return spark.createDataFrame(rows, schema)


def random_rows(n, seed=1, hot=0.5):
    rng = random.Random(seed)
    return [("hot" if rng.random() < hot else f"k{rng.randrange(5)}", rng.randrange(20_000), i, float(rng.randrange(100)))
            for i in range(n)]


def test_prior_keeps_keys_apart(spark):
    d = frame(spark, [("a", 1, 1, 1.0), ("b", 2, 2, 10.0), ("a", 3, 3, 2.0), ("b", 4, 4, 20.0)])
    got = {r.id: r.prior_sum for r in w.prior_sum(d, "k", "v", order=ORDER).collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 1.0, 4: 10.0}


def test_prior_equals_plain_window_with_a_hot_key(spark):
    d = frame(spark, random_rows(3000))
    got = prior(d, "k", "sec", ORDER, {"c": ("count", F.lit(1)), "s": ("sum", F.col("v")), "m": ("max", F.col("v")),
                                       "l": ("lag", F.col("v"))}, slice_secs=500)
    win = Window.partitionBy("k").orderBy(*ORDER)
    before = win.rowsBetween(Window.unboundedPreceding, -1)
    want = d.select("id", F.count("v").over(before).alias("c"), F.coalesce(F.sum("v").over(before), F.lit(0.0)).alias("s"),
                    F.max("v").over(before).alias("m"), F.lag("v").over(win).alias("l"))
    a = {r.id: (r.c, r.s, r.m, r.l) for r in got.collect()}
    assert a == {r.id: (r.c, r.s, r.m, r.l) for r in want.collect()}


@pytest.mark.parametrize("kind", ["sum", "count", "avg", "min", "max", "std"])
def test_rolling_equals_plain_range_frame(spark, kind):
    d = frame(spark, random_rows(2000, 2))
    got = {r.id: r.x for r in rolling(d, "k", "sec", {"x": (700, kind, F.col("v"))}, slice_secs=900).collect()}
    f = {"sum": F.sum, "count": F.count, "avg": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp}[kind]
    want = d.select("id", f("v").over(Window.partitionBy("k").orderBy("sec").rangeBetween(-700, -1)).alias("x"))
    for r in want.collect():
        x = r.x if r.x is not None or kind not in ("sum", "count") else 0
        assert (got[r.id] is None) == (x is None)
        assert x is None or abs(got[r.id] - x) < 1e-6


def test_rolling_reads_no_frame_again(spark):
    """Every frame starts where its block starts; a frame that slides is re-read for each second."""
    d = frame(spark, random_rows(50, 3))
    specs = {f"{k}{s}": (s, k, F.col("v")) for k in ("sum", "count", "avg", "min", "max", "std") for s in (300, 3600)}
    plan = rolling(d, "k", "sec", specs)._jdf.queryExecution().optimizedPlan().toString()
    frames = re.findall(r"specifiedwindowframe\((\w+), ([^,]+),", plan)
    assert frames and {start for _, start in frames} == {"unboundedpreceding$()"}


def test_rolling_of_several_widths_around_block_edges(spark):
    rows = [(k, s, i, float(s % 7)) for i, (k, s) in enumerate((k, s) for k in "ab" for s in [*range(-25, 45), 60, 61, 90] if (s + ord(k)) % 3)]
    d = frame(spark, rows)
    got = {r.id: (r.s, r.n, r.m) for r in rolling(d, "k", "sec", {"s": (10, "sum", F.col("v")), "n": (30, "count", F.lit(1)), "m": (7, "max", F.col("v"))}).collect()}
    for k, t, i, _ in rows:
        seen = {w: [v for k2, t2, _, v in rows if k2 == k and t - w <= t2 < t] for w in (7, 10, 30)}
        assert got[i] == (sum(seen[10]), len(seen[30]), max(seen[7], default=None))


def test_rolling_edge_and_ties(spark):
    # the edge t-W counts, the same second does not
    d = frame(spark, [("a", 0, 1, 1.0), ("a", 300, 2, 2.0), ("a", 300, 3, 4.0), ("a", 600, 4, 8.0), ("a", 901, 5, 1.0)])
    got = {r.id: r.n_5m for r in w.rolling_count(d, "k", (300,)).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2, 5: 0}


def test_empty_table(spark):
    d = frame(spark, [])
    assert w.prior_count(d, "k", order=ORDER).count() == 0
    assert w.rolling_sum(d, "k", "v").count() == 0


def test_features_ignore_later_rows(spark):
    rows = random_rows(400, 3)
    cut = 12_000
    early = [r for r in rows if r[1] < cut]

    def features(rs):
        d = w.prior_distinct(frame(spark, rs).withColumn("item", F.col("v") % 7), "k", "item", order=ORDER)
        d = w.rolling_std(d, "k", "v", 3600)
        return {r.id: (r.first_seen, r.prior_distinct, r.std) for r in d.where(F.col("sec") < cut).collect()}

    assert features(rows) == features(early)


def test_win_rate_counts_only_resolved(spark):
    d = spark.createDataFrame(
        [("a", 10, 1, 1, 20), ("a", 20, 2, 0, 30), ("a", 21, 3, 1, None), ("a", 40, 4, 1, 50)],
        "k string, sec bigint, id bigint, y int, res bigint")
    got = {r.id: (r.win_rate, r.has_resolved) for r in w.causal_win_rate(d, "k", "y", "res", order=ORDER).collect()}
    assert got == {1: (None, 0), 2: (None, 0), 3: (1.0, 1), 4: (0.5, 1)}


def test_prior_median_gap_against_brute_force(spark):
    import statistics

    rows = random_rows(120, 5)
    got = {r.id: r.prior_median_gap for r in w.prior_median_gap(frame(spark, rows), "k", order=ORDER).collect()}
    for k in {r[0] for r in rows}:
        gaps, last = [], None
        for _, sec, i, _ in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            assert got[i] == (statistics.median(gaps) if gaps else None)
            if last is not None:
                gaps.append(sec - last)
            last = sec


def test_qcut_keeps_ties_together(spark):
    d = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 1, 1, 1, 2, 3, 4, 5])], "id bigint, v double")
    got = {r.id: r.bucket for r in w.qcut(d, "v", 4).collect()}
    assert len({got[i] for i in range(4)}) == 1 and got[7] == max(got.values())


def test_plans_have_no_python_and_no_cartesian(spark):
    d = frame(spark, random_rows(10))
    for q in (w.prior_sum(d, "k", "v", order=ORDER), w.rolling_sum(d, "k", "v"), w.expanding_entropy(
            d.withColumn("c", F.lit("x")), "k", "id", "c", ["x"], order=ORDER)):
        plan = q._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
