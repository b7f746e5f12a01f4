"""Operator 10: nearest neighbours by inner product over randomly rotated one-bit codes.

Every vector is rotated by a seeded random orthogonal matrix; its code is the packed signs of the result.  Two scalars go with
it: its length, and the inner product of its unit vector with its code's unit vector.  For a query, rotated and held in
``QUERY_BITS`` bit planes, the inner product is estimated from popcounts of code and planes and the two scalars.  The estimate
comes with an error bound: ``eps`` standard deviations of the code's error (``sqrt(1 - c^2) / c / sqrt(D - 1)`` per unit of both
lengths) plus what the rounding of the query can add at most.  A vector is reranked, by the inner product of the original
vectors in double precision, only if its upper bound reaches the worst of the ``k`` best found so far.

Queries and vectors meet in (block of queries, slice of vectors) groups of bounded size, dealt out by hashes of ids, so no
vector or value that many rows share is hot, and no side is broadcast.  A group gives the ``k`` best per query; these are cut
to ``k`` in two steps.  All rows are indexed; nothing is fitted to the data.

Null ids, null or zero vectors and vectors with null or non-finite components take no part.  Vectors of different length are
not compared.  Equal scores go to the smaller id.  A repeated row (id and vector) counts once, and rows with the query's own id
are no candidates.  With fewer than ``k`` candidates all are given; empty tables give no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import in_batches, stored

QUERY_BITS = 8
EPS = 4.0
BLOCK, SLICE, CHUNK = 2048, 8192, 512
PRODUCT = 32  #: a pair scored by itself costs about as much as so many products of a chunk
SEED = 20


@lru_cache(maxsize=4)
def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes as uint64 words, lengths, corrections) of the rows of a matrix."""
    dim = vectors.shape[1]
    norm = np.sqrt((vectors * vectors).sum(axis=1))
    turned = vectors @ rotation(dim)
    bits = turned >= 0
    corr = np.abs(turned).sum(axis=1) / (np.sqrt(dim) * norm)
    packed = np.packbits(np.pad(bits, ((0, 0), (0, -dim % 64))), axis=1).view(np.uint64)
    return packed, norm, corr


class QueryPlanes:
    """Rotated queries as bit planes with what is needed to estimate inner products."""

    def __init__(self, queries: np.ndarray):
        dim = queries.shape[1]
        turned = queries @ rotation(dim)
        self.root, self.norm = np.sqrt(dim), np.sqrt((queries * queries).sum(axis=1))
        low = turned.min(axis=1)
        step = np.maximum((turned.max(axis=1) - low) / ((1 << QUERY_BITS) - 1), 1e-300)
        level = np.rint((turned - low[:, None]) / step[:, None])
        rounded = level * step[:, None] + low[:, None]
        self.slack = np.abs(turned - rounded).sum(axis=1) / self.root
        self.low, self.step, self.total = low, step, rounded.sum(axis=1)
        level = np.pad(level.astype(np.uint16), ((0, 0), (0, -dim % 64)))
        self.planes = [np.packbits((level >> b & 1).astype(bool), axis=1).view(np.uint64) for b in range(QUERY_BITS)]

    def code_products(self, codes: np.ndarray) -> np.ndarray:
        """Inner products of the rounded queries with the codes' unit vectors: queries x codes."""
        ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int32)
        levels = np.zeros((len(self.low), len(codes)), np.int32)
        for b, plane in enumerate(self.planes):
            hit = np.zeros(levels.shape, np.int32)
            for w in range(codes.shape[1]):
                hit += np.bitwise_count(plane[:, w, None] & codes[None, :, w])
            levels += hit << b
        on = levels * self.step[:, None] + ones[None, :] * self.low[:, None]  # sum over the positive signs
        return (2.0 * on - self.total[:, None]) / self.root


def search_group(q_ids, queries, ids, vectors, codes, norm, corr, k: int, eps: float = EPS):
    """Best ``k`` of a slice for each query of a block: (query index, vector id, score) arrays; ``ids`` ascend."""
    planes, dim = QueryPlanes(queries), queries.shape[1]
    nq = len(queries)
    best_s, best_i = np.full((nq, k), -np.inf), np.full((nq, k), np.iinfo(np.int64).max)
    spread = eps * np.sqrt(np.maximum(0.0, 1.0 - corr * corr)) / corr / np.sqrt(max(1, dim - 1)) * norm
    slack = 4 * dim * np.finfo(float).eps * planes.norm * norm.max(initial=0.0)  # more than a product of the chunk can be off

    def take(qi, vi):
        """Reranks (query, vector) pairs, ordered by query, into the best lists."""
        for a in range(0, len(qi), 1 << 16):  # bounded gather
            q, v = qi[a : a + (1 << 16)], vi[a : a + (1 << 16)]
            score = (queries[q] * vectors[v]).sum(axis=1)
            rows, start = np.unique(q, return_index=True)
            for r, s, e in zip(rows, start, [*start[1:], len(q)]):
                sc, ii = np.concatenate([best_s[r], score[s:e]]), np.concatenate([best_i[r], ids[v[s:e]]])
                o = np.lexsort((ii, -sc))[:k]
                best_s[r], best_i[r] = sc[o], ii[o]

    for a in range(0, len(ids), CHUNK):
        b = min(len(ids), a + CHUNK)
        guess = planes.code_products(codes[a:b]) * (norm[a:b] / corr[a:b])
        room = spread[a:b] * planes.norm[:, None] + planes.slack[:, None] * (norm[a:b] / corr[a:b])
        other = ids[a:b][None, :] != q_ids[:, None]
        first = np.zeros(guess.shape, bool)
        if b - a > k and not np.isfinite(best_s[:, -1]).all():  # the likely best first: they set the bar for the rest
            np.put_along_axis(first, np.argpartition(-guess, k, axis=1)[:, :k], True, axis=1)
        first &= other & (guess + room >= best_s[:, -1:])
        qi, vi = np.nonzero(first)
        take(qi, vi + a)
        qi, vi = np.nonzero(other & ~first & (guess + room >= best_s[:, -1:]))
        if len(qi) * PRODUCT > guess.size:  # many pairs are left: the products of the whole chunk say which of them can be among the best
            product = queries @ vectors[a:b].T
            near = ~(product[qi, vi] < best_s[qi, -1] - slack[qi])
            qi, vi = qi[near], vi[near]
        take(qi, vi + a)
    q, j = np.nonzero(np.isfinite(best_s))
    return q, best_i[q, j], best_s[q, j]


def build_codes(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, vec, dim, code, norm, corr) of all rows that can take part."""
    v = F.transform(vector, lambda x: x.cast("double"))
    ok = F.forall("vec", lambda x: F.coalesce((x > float("-inf")) & (x < float("inf")), F.lit(False))) & F.exists("vec", lambda x: x != 0)
    rows = rows.select(F.col(key).cast("bigint").alias("id"), v.alias("vec")).where(F.col("id").isNotNull() & F.coalesce(ok, F.lit(False)))
    rows = rows.dropDuplicates(["id", "vec"]).withColumn("dim", F.size("vec"))

    def code(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            codes, norms, corrs = [None] * len(dims), np.zeros(len(dims)), np.zeros(len(dims))
            flat, ends = b.column("vec").flatten().to_numpy(), np.cumsum(dims)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                m = flat[(ends[at] - d)[:, None] + np.arange(d)]
                c, norms[at], corrs[at] = encode(m)
                for i, x in zip(at, c):
                    codes[i] = x.tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("vec"), b.column("dim"), pa.array(codes, pa.binary()), pa.array(norms), pa.array(corrs)],
                names=["id", "vec", "dim", "code", "norm", "corr"])

    return in_batches(rows).mapInArrow(code, "id bigint, vec array<double>, dim int, code binary, norm double, corr double")


def nearest(index: DataFrame, queries, k: int = 20, eps: float = EPS, block: int = BLOCK, slice_rows: int = SLICE) -> DataFrame:
    """(query_id, rank, vec_id, score): ``queries`` is a condition on ``id`` that names the query rows of ``index``."""
    counts = index.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(queries, 1)).alias("q")).first()
    blocks, slices = max(1, -(-counts["q"] // block)), max(1, -(-counts["n"] // slice_rows))
    spot = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    # both sides come from one table: aliases keep their columns apart
    asked = index.where(queries).select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec"), F.col("dim").alias("dim"), spot("block", blocks).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("s"))
    there = index.select(*[F.col(c).alias(c) for c in ("id", "vec", "dim", "code", "norm", "corr")]).withColumn("s", spot("slice", slices)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    schema = "query_id bigint, s int, vec_id bigint, score double"
    names = ["query_id", "s", "vec_id", "score"]

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "s": pa.array([], pa.int32()), "vec_id": pa.array([], pa.int64()),
                          "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        dim = key[0].as_py()
        matrix = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy().reshape(-1, dim)
        right = right.sort_by("id")
        codes = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint64).reshape(right.num_rows, -1)
        q_ids = left.column("q_id").to_numpy()
        q, i, s = search_group(q_ids, matrix(left, "q_vec"), right.column("id").to_numpy(), matrix(right, "vec"), codes,
                               right.column("norm").to_numpy(), right.column("corr").to_numpy(), k, eps)
        return pa.table([pa.array(q_ids[q]), pa.array(np.full(len(q), key[2].as_py(), np.int32)), pa.array(i), pa.array(s)], names=names)

    met = asked.groupBy("dim", "b", "s").cogroup(there.groupBy("dim", "b", "s")).applyInArrow(meet, schema)
    order = [F.col("score").desc(), F.col("vec_id")]
    some = met.withColumn("r", F.row_number().over(W.partitionBy("query_id", F.pmod("s", F.lit(64))).orderBy(*order))).where(F.col("r") <= k)
    best = some.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(rows: DataFrame, queries, key: str = "vec_id", vector: str = "embedding", k: int = 20, **how) -> DataFrame:
    """Indexes all rows, stores the index in the shared folder and searches it."""
    return nearest(stored(build_codes(rows, key, vector), "codes"), queries, k, **how)
