"""U: unions, de-duplication and overlaps."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .joins import first_rows
from .ranking import top_fraction


def union_sources(*dfs: DataFrame) -> DataFrame:
    """Stack tables by column name, missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def dedup(df: DataFrame, keys, order) -> DataFrame:
    """First row per key in a fixed order."""
    return first_rows(df, keys, order)


def cohort_overlap(a: DataFrame, b: DataFrame, key: str, ts: str) -> DataFrame:
    """Shared keys of two cohorts and whether their time ranges overlap."""
    common = a.select(key).intersect(b.select(key)).agg(F.count(F.lit(1))).scalar()
    ra = a.agg(F.countDistinct(key).alias("keys_a"), F.min(ts).alias("lo_a"), F.max(ts).alias("hi_a"))
    hi_b, lo_b = b.agg(F.max(ts)).scalar(), b.agg(F.min(ts)).scalar()
    return ra.select(
        "keys_a", b.agg(F.countDistinct(key)).scalar().alias("keys_b"), common.alias("common"),
        ((F.col("lo_a") <= hi_b) & (lo_b <= F.col("hi_a"))).cast("int").alias("time_overlap"),
    )


def except_keys(a: DataFrame, b: DataFrame, key) -> DataFrame:
    """Distinct keys of a that b lacks."""
    keys = [key] if isinstance(key, str) else list(key)
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_anti")


def jaccard_pairs(df: DataFrame, key: str, member: str, block=512, members_per_slice=8192) -> DataFrame:
    """Jaccard of the member sets of every pair of keys that share a member; all other pairs have 0.

    Keys are cut into blocks and members into slices; a task takes two blocks of keys of one slice and counts what they share by a
    matrix product, so a member that very many keys hold is spread over blocks and only counts leave a task.
    """
    d = df.select(F.col(key).alias("k"), F.col(member).alias("m")).where("k is not null and m is not null").distinct()
    sizes = d.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    n = d.agg(F.approx_count_distinct("k").alias("k"), F.approx_count_distinct("m").alias("m")).first()
    blocks, slices = max(1, -(-n["k"] // block)), max(1, -(-n["m"] // members_per_slice))
    kind = dict(d.dtypes)["k"]
    spot = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    d = d.select("k", "m", spot("k", blocks).alias("own"), spot("m", slices).alias("slice"))
    left = d.withColumn("a", F.col("own")).withColumn("b", F.explode(F.sequence(F.col("own"), F.lit(blocks - 1))))
    right = d.toDF(*d.columns).withColumn("b", F.col("own")).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("own"))))

    def count(key, l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        at = pd.concat([l["m"], r["m"]]).drop_duplicates().reset_index(drop=True)
        place = pd.Series(at.index, index=at)

        def table(x):
            keys, i = np.unique(x["k"].to_numpy(), return_inverse=True)
            m = np.zeros((len(keys), len(at)), np.float32)  # counts of a slice are far below 2^24
            m[i, place[x["m"]].to_numpy()] = 1.0
            return keys, m

        (lk, x), (rk, y) = table(l), table(r)
        both = x @ y.T if len(lk) and len(rk) else np.zeros((len(lk), len(rk)))
        p, q = np.nonzero(both)
        keep = lk[p] < rk[q] if key[0] == key[1] else np.ones(len(p), bool)
        p, q = p[keep], q[keep]
        one, two = lk[p], rk[q]
        swap = one > two
        return pd.DataFrame({"a": np.where(swap, two, one), "b": np.where(swap, one, two), "common": both[p, q].astype("int64")})

    cols = ["k", "m", "a", "b", "slice"]
    both = left.select(*cols).groupBy("a", "b", "slice").cogroup(right.select(*cols).groupBy("a", "b", "slice")).applyInPandas(
        count, f"a {kind}, b {kind}, common bigint").groupBy("a", "b").agg(F.sum("common").alias("common"))
    for side in ("a", "b"):
        both = both.join(sizes.select(F.col("k").alias(side), F.col("n").alias(f"n_{side}")), side)
    union = F.col("n_a") + F.col("n_b") - F.col("common")
    return both.select("a", "b", "common", (F.col("common") / union).alias("jaccard"))


def topset_overlap(df: DataFrame, s1: str, s2: str, frac: float, uid: str) -> DataFrame:
    """Rows shared by two top sets against k*k/n expected for independent scores."""
    a = top_fraction(df, s1, frac, uid).select(uid)
    b = top_fraction(df, s2, frac, uid).select(uid)
    n = df.agg(F.count(F.lit(1))).scalar()
    k = a.agg(F.count(F.lit(1))).scalar()
    g = a.join(b, uid).agg(F.count(F.lit(1)).alias("overlap"))
    return g.select("overlap", k.alias("k"), (k * k / n).alias("expected"))
