"""Isolation forest with trees grown inside Spark and kept as rows.

Each tree draws its own subsample by a hash of (row id, tree), so no two trees share a draw, a re-run draws the same rows, and the
rows that move to the trees number at most about ``n_trees * sample`` at any size of the table.  A group holds the subsample of one
tree and grows it level by level with array operations; the result is one row of packed node arrays.  A model therefore has at
most ``n_trees * 2 * sample`` nodes of 21 bytes: its size follows from the parameters alone, which is what allows the broadcast.

All rows are scored once; the smallest and largest training score that scale the result come out of the same pass.  Null, NaN and
infinite features count as 0, in trees and in scores alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage

TREES, SAMPLE = 200, 50_000
_EULER = 0.5772156649015329
_TREE = "tree int, size int, feature binary, cut binary, child binary, height binary"


def average_path(n) -> np.ndarray:
    """Mean depth of a failed search among ``n`` rows: what a leaf of ``n`` rows still adds."""
    n = np.asarray(n, float)
    deep = 2 * (np.log(np.maximum(n - 1, 1)) + _EULER) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, deep, np.where(n == 2, 1.0, 0.0))


def grow_tree(x: np.ndarray, limit: int, rng: np.random.Generator):
    """(feature, cut, child, height) of the nodes of a tree over the rows of ``x``.

    A row at node i goes to ``child[i] + (x[feature[i]] >= cut[i])``; leaves lead to themselves.  All nodes of a level are split
    at once: at a random value of a random feature that varies inside the node.
    """
    feature, cut, child, height = [], [], [], []
    at = np.zeros(len(x), np.int64)  # the node of each row, as an index into its level
    rows, base, depth = np.arange(len(x)), 0, 0
    while True:
        order = np.argsort(at, kind="stable")
        rows, at = rows[order], at[order]
        head = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(1, np.int64)
        size = np.diff(np.r_[head, len(at)])
        n = len(size)
        if len(at):
            lo, hi = np.minimum.reduceat(x[rows], head, axis=0), np.maximum.reduceat(x[rows], head, axis=0)
        else:
            lo = hi = np.zeros((1, x.shape[1]))
        open_ = hi > lo
        split = open_.any(axis=1) & (depth < limit)
        nth = np.floor(rng.random(n) * open_.sum(axis=1)) + 1
        f = np.argmax(np.cumsum(open_, axis=1) >= nth[:, None], axis=1)
        a, z = lo[np.arange(n), f], hi[np.arange(n), f]
        c = a + (z - a) * (1 - rng.random(n))
        c = np.where(c > a, np.minimum(c, z), z)  # both sides keep a row
        first = base + n + 2 * (np.cumsum(split) - 1)
        feature.append(np.where(split, f, 0))
        cut.append(np.where(split, c, np.inf))
        child.append(np.where(split, first, base + np.arange(n)))
        height.append(np.where(split, 0.0, depth + average_path(size)))
        if not split.any():
            return tuple(np.concatenate(v) for v in (feature, cut, child, height))
        node = np.repeat(np.arange(n), size)
        go = split[node]
        rows, node = rows[go], node[go]
        at = 2 * (np.cumsum(split) - 1)[node] + (x[rows, f[node]] >= c[node])
        base, depth = base + n, depth + 1


def clean(cols) -> list[Column]:
    """Features as doubles; null, NaN and infinite values are 0."""
    d = [F.col(c).cast("double") for c in cols]
    return [F.when((x > float("-inf")) & (x < float("inf")), x).otherwise(0.0) for x in d]


def fit_trees(train: DataFrame, uid: str, cols, n_trees=TREES, sample=SAMPLE, seed=0) -> DataFrame:
    """One row per tree: (tree, size, feature, cut, child, height); ``size`` is the rows that a full subsample has."""
    n = train.count()
    want = min(sample, n)
    share = want / max(n, 1)
    limit = max(1, math.ceil(math.log2(max(want, 2))))
    names = [f"x{i}" for i in range(len(cols))]
    draw = lambda t: F.shiftrightunsigned(F.xxhash64(F.col(uid), t, F.lit(seed)), 11) < int(share * (1 << 53))
    mine = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)), draw)
    dealt = train.select(*[c.alias(x) for c, x in zip(clean(cols), names)], F.explode(mine).alias("tree"))

    def grow(key, t):
        tree = key[0].as_py()
        x = np.column_stack([t.column(c).to_numpy() for c in names])
        f, c, k, h = grow_tree(x, limit, np.random.default_rng([seed, tree]))
        packed = [f.astype(np.int8 if len(cols) < 128 else np.int32), c, k.astype(np.int32), h]
        return pa.table([pa.array([tree], pa.int32()), pa.array([want], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in packed]],
                        names=["tree", "size", "feature", "cut", "child", "height"])

    return dealt.groupBy("tree").applyInArrow(grow, _TREE)


def unpack(row, n_cols: int):
    """Node arrays of a row of ``fit_trees``."""
    kinds = {"feature": np.int8 if n_cols < 128 else np.int32, "cut": np.float64, "child": np.int32, "height": np.float64}
    return tuple(np.frombuffer(row[c], k) for c, k in kinds.items())


def path_lengths(x: np.ndarray, tree) -> np.ndarray:
    """Height of the leaf that each row of ``x`` reaches."""
    feature, cut, child, height = tree
    flat, base = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
    at = np.zeros(len(x), np.int32)
    while True:
        to = child[at] + (flat[base + feature[at]] >= cut[at])
        if np.array_equal(to, at):
            return height[at]
        at = to


def raw_scores(df: DataFrame, trees: DataFrame, cols, out: str) -> DataFrame:
    """``df`` with 2 ** -(mean path / average path of a full subsample); higher is more isolated."""
    rows = trees.orderBy("tree").collect()  # bounded by the parameters, see above
    model = [unpack(r, len(cols)) for r in rows]
    norm = float(average_path(rows[0]["size"])) if rows else 0.0
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for vals in parts:
            x = np.column_stack([v.to_numpy(dtype=float) for v in vals])
            total = np.zeros(len(x))
            for tree in shared.value:
                total += path_lengths(x, tree)
            mean = total / max(1, len(shared.value))
            yield pd.Series(np.power(2.0, -mean / norm) if norm else np.full(len(x), 0.5))

    return df.withColumn(out, score(*clean(cols)))


def iforest_score(df: DataFrame, uid: str, cols, train: Column | None = None, n_trees=TREES, sample=SAMPLE, seed=0, out="anomaly") -> DataFrame:
    """Isolation-forest score of every row of ``df``, scaled by the smallest and largest score of its training rows.

    ``train`` is a condition on ``df`` that names the training rows (all by default).  Scores are clipped to [0, 1]; they are
    null where the training scores do not vary.
    """
    chosen = F.lit(True) if train is None else F.coalesce(train, F.lit(False))
    flagged = df.withColumn("_in", chosen)
    trees = cut_lineage(fit_trees(flagged.where("_in"), uid, cols, n_trees, sample, seed))
    scored = cut_lineage(raw_scores(flagged, trees, cols, "_raw"))
    ends = scored.agg(F.struct(F.min(F.when(F.col("_in"), F.col("_raw"))).alias("a"), F.max(F.when(F.col("_in"), F.col("_raw"))).alias("z"))).scalar()
    scaled = (F.col("_raw") - F.col("_ends.a")) / F.nullif(F.col("_ends.z") - F.col("_ends.a"), F.lit(0.0))
    clipped = F.when(scaled.isNotNull(), F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)))
    return scored.withColumn("_ends", ends).withColumn(out, clipped).drop("_in", "_raw", "_ends")
