"""Nearest neighbours with a per-task top-k.

``block_topk`` is exact: queries are cut into ``B`` blocks and base rows into ``S`` slices by hash; every (block, slice)
meets in one bounded task that keeps only k rows per query, so neither side is broadcast and no
pair list is shuffled.  A final ranking merges the S partial lists.  Inside a task products are taken in tiles of a few MB and
only pairs that may be among the k best are scored.

``center_topk`` is exact as well, for a base of a few vectors such as class centroids: below a checked size these are sent to the
points, which then move nowhere; beyond it, it is ``block_topk``.

``lsh_topk`` is the locality-sensitive form for many queries: rows meet in buckets of random projections, so a vector is copied
once per table, however many queries there are, and every meeting is reranked by the exact score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage

CENTER_CELLS = 1 << 20  #: numbers in a base that may be sent to all tasks: 8 MB
CELLS = 1 << 21  #: numbers in a block of queries or a slice of base rows: 16 MB
ROWS, FIRST, WIDE = 256, 512, 4096  #: queries of a tile, base rows of the first tile and of the others
PAIRS = 1 << 16  #: pairs scored at once


def _id_kind(df: DataFrame, col: str) -> str:
    kind = dict(df.dtypes)[col]
    return "bigint" if kind in ("tinyint", "smallint", "int", "bigint") else kind


def _scores(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Rows of x against rows of y; rounded, so that equal vectors tie whatever the block shape."""
    if metric == "cosine":
        s = (x @ y.T) / np.maximum(np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)), 1e-300)
    else:
        s = 2 * (x @ y.T) - (x * x).sum(1)[:, None] - (y * y).sum(1)[None, :]
    return np.round(s, 12)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of an Arrow list column as rows of doubles."""
    rows = column.combine_chunks()
    dims = np.unique(np.diff(rows.offsets.to_numpy()))
    if len(dims) != 1:
        raise ValueError(f"vectors of one length are needed, not of {dims.tolist()}")
    return rows.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), dims[0])


def _best(x: np.ndarray, y: np.ndarray, k: int, metric: str, own=None, copies=0):
    """The k best rows of y for each row of x: (row of x, row of y, score), best first, ties to the smaller row of y.

    Products are taken tile by tile and only pairs that may reach the k best so far are scored, each by itself, so equal vectors
    tie whatever the tile.  ``own(i, j)`` marks pairs to leave out, at most ``copies`` per row of x.
    """
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    slack = 4 * x.shape[1] * np.finfo(float).eps
    if metric == "cosine":
        nx, ny = np.sqrt(xx), np.sqrt(yy)
        left, right = x / np.where(nx > 0, nx, 1.0)[:, None], (y / np.where(ny > 0, ny, 1.0)[:, None]).T
        slack = np.full(len(x), slack)
    else:
        left, right = 2 * x, y.T
        slack = slack * (xx + yy.max(initial=0.0))

    def scored(i, j):
        parts = []
        for a in range(0, len(i), PAIRS):  # bounded gather
            p, q = i[a : a + PAIRS], j[a : a + PAIRS]
            xy = (x[p] * y[q]).sum(1)
            parts.append(xy / np.maximum(nx[p] * ny[q], 1e-300) if metric == "cosine" else 2 * xy - xx[p] - yy[q])
        return np.round(np.concatenate(parts), 12) if parts else np.zeros(0)

    edges = [0, *range(min(len(y), FIRST), len(y), WIDE), len(y)]
    out = []
    for a in range(0, len(x), ROWS):
        z = min(len(x), a + ROWS)
        i, j, s = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        bar = np.full(z - a, -np.inf)  # a score has to pass it
        for c, e in zip(edges, edges[1:]):
            got = left[a:z] @ right[:, c:e]
            if metric != "cosine":
                got -= yy[c:e]
                got -= xx[a:z, None]
            if not c and k + copies < e:
                bar = np.partition(got, e - k - copies, axis=1)[:, e - k - copies] - 2e-12 - 2 * slack[a:z]
            p, q = np.nonzero(got >= bar[:, None])
            p, q = p + a, q + c
            if own is not None:
                other = ~own(p, q)
                p, q = p[other], q[other]
            t = scored(p, q)
            good = np.isfinite(t)
            i, j, s = np.concatenate([i, p[good]]), np.concatenate([j, q[good]]), np.concatenate([s, t[good]])
            order = np.lexsort((j, -s, i))
            i, j, s = i[order], j[order], s[order]
            first = np.searchsorted(i, np.arange(a, z))
            keep = np.arange(len(i)) - first[i - a] < k
            i, j, s = i[keep], j[keep], s[keep]
            # rows to come are larger: they need a score that is rounded to more than the worst kept
            first = np.searchsorted(i, np.arange(a, z + 1))
            full = np.diff(first) == k
            bar = np.where(full, s[np.minimum(first[1:], len(s)) - 1] + 0.5e-12 - slack[a:z], -np.inf) if len(s) else np.full(z - a, -np.inf)
        out.append((i, j, s))
    return tuple(np.concatenate(v) for v in zip(*out)) if out and len(y) else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _meeting(k: int, metric: str, exclude_self: bool):
    """A task that gives the k best base rows (right) of each query (left)."""

    def part(left: pa.Table, right: pa.Table) -> pa.Table:
        i, j, s = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        right = right.sort_by("_id")
        q, b = left.column("_id").combine_chunks(), right.column("_id").combine_chunks()
        if len(q) and len(b):
            own = copies = None
            if exclude_self:
                own = lambda i, j: pc.fill_null(pc.equal(q.take(pa.array(i)), b.take(pa.array(j))), False).to_numpy(zero_copy_only=False)
                copies = pc.max(pc.value_counts(b).field("counts")).as_py()
            x, y = _matrix(left.column("_v")), _matrix(right.column("_v"))
            fx, fy = np.isfinite(x).all(1), np.isfinite(y).all(1)
            q, b = q.filter(pa.array(fx)), b.filter(pa.array(fy))
            i, j, s = _best(x if fx.all() else x[fx], y if fy.all() else y[fy], k, metric, own, copies or 0)
        return pa.table({"q": q.take(pa.array(i)), "b": b.take(pa.array(j)), "score": pa.array(s)})

    return part


def _vector(df: DataFrame, vec: str):
    """Vectors of floats travel as they are, others as doubles."""
    return F.col(vec) if dict(df.dtypes)[vec] == "array<float>" else F.col(vec).cast("array<double>")


def group_parts(asked: DataFrame, there: DataFrame, q_block: int, b_slice: int) -> DataFrame:
    """(_h, _blks, _slcs): the blocks and slices of every group ``_g`` that both sides have, a row per group."""
    parts = lambda d, n, out: d.groupBy("_g").agg(F.ceil(F.count(F.lit(1)) / n).cast("int").alias(out))
    both = parts(asked, q_block, "_blks").join(parts(there, b_slice, "_slcs").withColumnRenamed("_g", "_h"), F.col("_g").eqNullSafe(F.col("_h")))
    return both.select("_h", "_blks", "_slcs")


def _met(asked: DataFrame, there: DataFrame, k: int, metric: str, q_block, b_slice, exclude_self: bool) -> DataFrame:
    """(q, b, score): rows (_id, _v) of both sides with an equal ``_g`` meet in blocks of queries and slices of base rows; a pair
    that shares several groups may come back several times, with the same score."""
    if q_block is None or b_slice is None:
        rows = max(256, CELLS // max(1, there.agg(F.max(F.size("_v"))).first()[0] or 1))
        q_block, b_slice = q_block or rows, b_slice or rows
    size = cut_lineage(group_parts(asked, there, q_block, b_slice))
    spot = lambda n: F.pmod(F.xxhash64("_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = asked.join(size, F.col("_g").eqNullSafe(F.col("_h"))).withColumn("_blk", spot("_blks")).withColumn("_slc", each("_slcs"))
    b = there.join(size, F.col("_g").eqNullSafe(F.col("_h"))).withColumn("_slc", spot("_slcs")).withColumn("_blk", each("_blks"))
    cols, keys = ["_id", "_v", "_g", "_blk", "_slc"], ["_g", "_blk", "_slc"]
    return (
        q.select(cols).groupBy(keys).cogroup(b.select(cols).groupBy(keys))
        .applyInArrow(_meeting(k, metric, exclude_self), f"q {dict(asked.dtypes)['_id']}, b {dict(there.dtypes)['_id']}, score double")
    )


def block_topk(
    queries: DataFrame, base: DataFrame, qid: str, bid: str, vec: str, k: int, metric="cosine", bias: str | None = None,
    restrict: str | None = None, q_block: int | None = None, b_slice: int | None = None, exclude_self=False,
) -> DataFrame:
    """Top-k base rows per query: (qid, bid, score, rank); ties go to the smaller base id.

    ``metric`` is cosine (largest first) or l2 (smallest squared distance first, score negative).
    ``restrict`` names a column both sides must share; it is a key of the meetings.  Ids may be of any type; integers come back
    as bigint.  A block or slice has as many rows as make ``CELLS`` numbers, unless given.  Null vectors take no part.
    """
    group = F.col(restrict).cast("string") if restrict else F.lit("")
    side = lambda d, key: d.select(F.col(key).cast(_id_kind(d, key)).alias("_id"), _vector(d, vec).alias("_v"), group.alias("_g")).where("_v is not null")
    got = _met(side(queries, qid), side(base, bid), k, metric, q_block, b_slice, exclude_self)
    # at most k * slices rows per query reach the ranking
    w = Window.partitionBy("q").orderBy(F.col("score").desc(), "b")
    ranked = got.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)
    return ranked.withColumnsRenamed({"q": qid, "b": bid if bid != qid else f"{bid}_base"})


def center_topk(points: DataFrame, centers: DataFrame, uid: str, cid: str, vec: str, k: int, metric="cosine", limit=CENTER_CELLS) -> DataFrame:
    """Top-k centres per point, as ``block_topk``; centres of at most ``limit`` numbers go to the points instead of meeting them."""
    rows = centers.select(F.col(cid).cast(_id_kind(centers, cid)).alias("c"), F.col(vec).cast("array<double>").alias("v")).where("v is not null").limit(limit + 1)
    size = rows.agg(F.coalesce(F.sum(F.size("v") + 1), F.lit(0))).first()[0]
    if size > limit:
        return block_topk(points, centers, uid, cid, vec, k, metric)
    found = sorted((r["c"], r["v"]) for r in rows.collect())
    names = [c for c, _ in found]
    y = np.array([v for _, v in found], float)
    shared = points.sparkSession.sparkContext.broadcast(y)

    @F.pandas_udf("array<struct<i:int,score:double>>")
    def best(v: pd.Series) -> pd.Series:
        out = np.full(len(v), None, object)
        there = np.flatnonzero(v.notna().to_numpy())
        if len(there) and len(shared.value):
            s = _scores(np.vstack(v.to_numpy()[there]).astype(float), shared.value, metric)
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            for row, t, sc in zip(there, top.tolist(), np.take_along_axis(s, top, axis=1).tolist()):
                out[row] = [{"i": i, "score": x} for i, x in zip(t, sc)]
        return pd.Series(out)

    got = points.select(F.col(uid).cast(_id_kind(points, uid)).alias(uid), best(F.col(vec).cast("array<double>")).alias("_b"))
    got = got.select(uid, F.posexplode("_b").alias("_p", "_x"))
    labels = F.array(*[F.lit(c) for c in names]).cast(f"array<{_id_kind(centers, cid)}>")
    name = cid if cid != uid else f"{cid}_base"
    return got.select(uid, F.get(labels, F.col("_x.i")).alias(name), F.col("_x.score").alias("score"), (F.col("_p") + 1).cast("bigint").alias("rank"))


def lsh_topk(
    queries: DataFrame, base: DataFrame, qid: str, bid: str, vec: str, k: int, metric="cosine", tables=16, directions=16, probes=2,
    slice_rows: int | None = None, exclude_self=False, seed=0,
) -> DataFrame:
    """Approximate top-k base rows per query: (qid, bid, score, rank), scores exact, ties to the smaller base id.

    In each of ``tables`` a vector is projected on ``directions`` random directions; its bucket is the direction, with its sign, of
    the largest projection, so vectors of a small angle tend to share it.  A query opens its ``probes`` best buckets per table.
    Buckets of more than ``slice_rows`` rows (by default ``CELLS`` numbers) on a side are met in parts.  More tables and probes give more recall; vectors are compared
    by angle, so under ``l2`` their lengths should be alike.  A query whose buckets hold nobody has no rows.
    """
    kinds = _id_kind(queries, qid), _id_kind(base, bid)

    def buckets(n: int):
        @F.pandas_udf("array<int>")
        def code(v: pd.Series) -> pd.Series:
            out = np.full(len(v), None, object)
            there = np.flatnonzero(v.notna().to_numpy())
            if len(there):
                x = np.vstack(v.to_numpy()[there]).astype(float)
                turn = np.random.default_rng(seed).standard_normal((tables, x.shape[1], directions))
                codes = []
                for t in range(tables):
                    p = x @ turn[t]
                    best = np.argsort(-np.concatenate([p, -p], axis=1), axis=1, kind="stable")[:, :n]
                    codes.append(best + 2 * directions * t)
                for row, c in zip(there, np.concatenate(codes, axis=1).tolist()):
                    out[row] = c
            return pd.Series(out)

        return code

    def dealt(df, key, kind, n):
        d = df.select(F.col(key).cast(kind).alias("_id"), _vector(df, vec).alias("_v"))
        return d.withColumn("_g", F.explode(buckets(n)("_v")))

    got = _met(dealt(queries, qid, kinds[0], probes), dealt(base, bid, kinds[1], 1), k, metric, slice_rows, slice_rows, exclude_self)
    # a pair met in several buckets has one score, so it has one dense rank
    w = Window.partitionBy("q").orderBy(F.col("score").desc(), "b")
    ranked = got.withColumn("rank", F.dense_rank().over(w).cast("bigint")).where(F.col("rank") <= k).distinct()
    return ranked.withColumnsRenamed({"q": qid, "b": bid if bid != qid else f"{bid}_base"})
