"""Operator 12: hard-negative mining by a vertical scan with branch and bound (BOND).

Components become floor(``scale`` * x); a score is the integer inner product with the anchor.  For each anchor the ``positives``
best other rows of its label are its positives; for each of them the ``negatives`` best rows of other labels whose score lies
between ``low`` and ``high`` per cent of the positive's score are given out.

Rows are dealt by a hash into slices of about ``SLICE`` rows, stored vertically: one row per slice that holds each dimension as a
packed column.  A task meets one slice with a block of at most about ``BLOCK`` anchors.  For an anchor it reads the columns in the
order of descending magnitude of the anchor's components, ``STEP`` at a time, and adds them to the partial scores.  The slice's
smallest and largest value of each column bound what the columns not yet read can add, so each candidate has a range of scores;
a candidate leaves the bitmap as soon as its range cannot matter:

* *positives*: its upper end is below the k-th largest lower end;
* *negatives*: for every window its range lies outside, or its upper end is below the k-th largest lower end of those that are
  surely inside.

What is left at the last column has its exact score.  Each task gives at most k rows per anchor (and window), which are cut to k in
two steps.  Positives are searched among slices of the anchor's label only (an equal join on the label), negatives in all slices.

Null ids, labels and vectors and vectors with null or non-finite components take no part; vectors of different length are not
compared.  Equal scores go to the smaller id.  A repeated row (id, label and vector) counts once; rows that share the anchor's id
are neither its positives nor its negatives.  Without positives or negatives an anchor has no rows; empty tables give none; further
columns are ignored.  Partial scores are float64 where all sums stay below 2^53, else 64-bit integers; the results are the same as
long as scores fit in 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import stored

SCALE = 256
SLICE, BLOCK, STEP = 4096, 1024, 8


def prepare(rows: DataFrame, label: Column, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, h, label, dim, vec) of the rows that take part; ``h`` tells rows apart that share an id."""
    fine = F.forall(vector, lambda x: F.coalesce((x.cast("double") > float("-inf")) & (x.cast("double") < float("inf")), F.lit(False)))
    rows = rows.where(F.coalesce(fine, F.lit(False))).select(
        F.col(key).cast("bigint").alias("id"), label.cast("bigint").alias("label"),
        F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint")).alias("vec"), F.xxhash64(vector).alias("h"))
    rows = rows.where("id is not null and label is not null").dropDuplicates(["id", "label", "h"])
    return rows.withColumn("h", F.xxhash64("label", "h")).withColumn("dim", F.size("vec"))


def vertical(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, slice, blocks, ids, hashes, labels, columns): one row per slice with its columns packed; ``rows`` has slices and blocks."""
    spread = rows.where("blocks > 0").withColumn("slice", F.pmod(F.xxhash64("id", "h"), F.col("slices")).cast("int"))
    keys = [*by, "slice", "blocks"]
    kinds = dict(rows.dtypes) | {"slice": "int"}

    def pack(t: pa.Table) -> pa.Table:
        order = np.lexsort((t.column("h").to_numpy(), t.column("id").to_numpy()))
        dim = t.column("dim")[0].as_py()
        m = t.column("vec").combine_chunks().flatten().to_numpy().reshape(len(order), dim)[order]
        head = [t.column(c).slice(0, 1) for c in keys]
        ids = [pa.array([np.ascontiguousarray(t.column(c).to_numpy()[order]).tobytes()], pa.binary()) for c in ("id", "h", "label")]
        cols = pa.array([[np.ascontiguousarray(m[:, d]).tobytes() for d in range(dim)]], pa.list_(pa.binary()))
        return pa.table([*head, *ids, cols], names=[*keys, "ids", "hashes", "labels", "columns"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", ids binary, hashes binary, labels binary, columns array<binary>"
    return spread.groupBy(*keys).applyInArrow(pack, schema)


class Slice:
    """The columns of a slice; rows ascend by id."""

    def __init__(self, row, most: int):
        self.ids, self.hashes, self.labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "hashes", "labels"))
        self.cols = np.array([np.frombuffer(c, np.int64) for c in row["columns"]]).reshape(len(row["columns"]), len(self.ids))
        self.low, self.high = self.cols.min(axis=1), self.cols.max(axis=1)
        top = max(int(np.abs(self.low.astype(float)).max(initial=0)), int(np.abs(self.high.astype(float)).max(initial=0)))
        self.exact = most * top * max(1, len(self.cols)) < 1 << 53
        if self.exact:
            self.cols = self.cols.astype(float)

    def scan(self, anchor: np.ndarray, bitmap: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rows of ``bitmap`` that ``keep(lower, upper)`` never drops, and their scores."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        a = anchor[order].astype(self.cols.dtype)
        ends = np.stack([a * self.low[order].astype(a.dtype), a * self.high[order].astype(a.dtype)])
        least, most = np.cumsum(ends.min(axis=0)[::-1])[::-1], np.cumsum(ends.max(axis=0)[::-1])[::-1]
        alive = np.flatnonzero(bitmap)
        score = np.zeros(len(alive), self.cols.dtype)
        for s in range(0, len(order), STEP):
            if not len(alive):
                break
            some = order[s : s + STEP]
            score = score + a[s : s + STEP] @ (self.cols[some] if len(alive) == len(bitmap) else self.cols[np.ix_(some, alive)])
            rest = (least[s + STEP], most[s + STEP]) if s + STEP < len(order) else (0, 0)
            left = keep(score + rest[0], score + rest[1])
            alive, score = alive[left], score[left]
        return alive, score.astype(np.int64)


def best_of(k: int):
    """Keeps what may be among the ``k`` best."""

    def keep(low, high):
        return high >= np.partition(low, -k)[-k] if len(low) > k else np.ones(len(low), bool)

    return keep


def best_inside(windows: list[tuple[int, int]], k: int):
    """Keeps what may be among the ``k`` best inside one of the windows (both ends included)."""

    def keep(low, high):
        out = np.zeros(len(low), bool)
        for a, b in windows:
            sure = low[(low >= a) & (high <= b)]
            bar = np.partition(sure, -k)[-k] if len(sure) >= k else a
            out |= (high >= bar) & (low <= b)
        return out

    return keep


def _first(score, ids, hashes, k: int) -> np.ndarray:
    return np.lexsort((hashes, ids, -score))[:k]


_FOUND = [("a_id", pa.int64()), ("a_h", pa.int64()), ("p_id", pa.int64()), ("p_h", pa.int64()), ("p_score", pa.int64()), ("id", pa.int64()), ("h", pa.int64()), ("score", pa.int64())]


def meet(anchors: DataFrame, slices: DataFrame, by: list[str], search) -> DataFrame:
    """Blocks of anchors meet slices: ``search(slice, anchor row, vector)`` gives (p_id, p_h, p_score, places, scores) runs."""
    block = F.pmod(F.xxhash64(F.lit("block"), "id", "h"), F.col("blocks")).cast("int")
    asked = anchors.withColumn("block", block).withColumn("slice", F.explode(F.sequence(F.lit(0), (F.col("slices") - 1).cast("int"))))
    there = slices.withColumn("block", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    keys = [*by, "block", "slice"]

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        found = {c: [] for c, _ in _FOUND}
        if left.num_rows and right.num_rows:
            vectors = [np.array(v, np.int64) for v in left.column("vec").to_pylist()]
            most = max((int(np.abs(v.astype(float)).max(initial=0)) for v in vectors), default=0)
            for packed in right.to_pylist():
                part = Slice(packed, most)
                for row, v in zip(left.drop_columns(["vec"]).to_pylist(), vectors):
                    for p_id, p_h, p_score, at, score in search(part, row, v):
                        n = len(at)
                        for c, x in zip(found, (row["id"], row["h"], p_id, p_h, p_score)):
                            found[c].append(np.full(n, x, np.int64))
                        for c, x in zip(("id", "h", "score"), (part.ids[at], part.hashes[at], score)):
                            found[c].append(x)
        return pa.table([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in found.values()], schema=pa.schema(_FOUND))

    return asked.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInArrow(task, ", ".join(f"{c} bigint" for c, _ in _FOUND))


def cut(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The ``k`` best rows per key with their rank, in two steps."""
    order = [F.col("score").desc(), F.col("id"), F.col("h")]
    some = found.withColumn("r", F.row_number().over(W.partitionBy(*keys, F.pmod(F.xxhash64("id"), F.lit(64))).orderBy(*order))).where(F.col("r") <= k)
    return some.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k).drop("r")


def find_positives(rows: DataFrame, anchors: Column, k: int, slice_rows: int = SLICE, block: int = BLOCK) -> DataFrame:
    """(a_id, a_h, rank, id, h, score): the ``k`` best other rows of the same label."""
    by = ["dim", "label"]
    sizes = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / slice_rows).alias("slices"), F.ceil(F.count(F.when(anchors, 1)) / block).alias("blocks"))
    known = rows.join(sizes, by)

    def search(part: Slice, row, v):
        at, score = part.scan(v, part.ids != row["id"], best_of(k))
        top = _first(score, part.ids[at], part.hashes[at], k)
        yield 0, 0, 0, at[top], score[top]

    found = meet(known.where(anchors).select(*by, "id", "h", "vec", "slices", "blocks"), vertical(known, by), by, search)
    return cut(found, ["a_id", "a_h"], k)


def find_negatives(rows: DataFrame, wanted: DataFrame, k: int, low: int, high: int, slice_rows: int = SLICE, block: int = BLOCK) -> DataFrame:
    """(a_id, a_h, p_id, p_h, p_score, rank, id, h, score) for ``wanted``: anchors with ``positives`` (id, h, score)."""
    sizes = rows.agg(F.count(F.lit(1)).alias("n")).first()["n"], wanted.count()
    add = {"slices": F.lit(max(1, -(-sizes[0] // slice_rows))).cast("bigint"), "blocks": F.lit(max(1, -(-sizes[1] // block))).cast("bigint")}

    def search(part: Slice, row, v):
        spans = [(-(-low * p["score"] // 100), high * p["score"] // 100) for p in row["positives"]]
        windows = sorted({s for s in spans if s[0] <= s[1]})
        if not windows:
            return
        at, score = part.scan(v, (part.labels != row["label"]) & (part.ids != row["id"]), best_inside(windows, k))
        for p, (a, b) in zip(row["positives"], spans):
            inside = np.flatnonzero((score >= a) & (score <= b))
            top = inside[_first(score[inside], part.ids[at[inside]], part.hashes[at[inside]], k)]
            yield p["id"], p["h"], p["score"], at[top], score[top]

    anchors = wanted.withColumns(add).select("dim", "label", "id", "h", "vec", "positives", "slices", "blocks")
    found = meet(anchors, vertical(rows.withColumns(add), ["dim"]), ["dim"], search)
    return cut(found, ["a_id", "a_h", "p_id", "p_h", "p_score"], k)


def mine_hard_negatives(rows: DataFrame, anchors: Column, label: Column | None = None, key: str = "vec_id", vector: str = "embedding",
                        positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = SCALE, **sizes) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``anchors`` is a condition on ``id``."""
    used = stored(prepare(rows, F.col("label") if label is None else label, key, vector, scale), "vectors")
    near = find_positives(used, anchors, positives, **sizes)
    near = near.groupBy("a_id", "a_h").agg(F.collect_list(F.struct("id", "h", "score")).alias("positives"))  # at most ``positives``
    wanted = stored(used.join(near.select(F.col("a_id").alias("id"), F.col("a_h").alias("h"), "positives"), ["id", "h"]), "anchors")
    found = find_negatives(used, wanted, negatives, low, high, **sizes)
    return found.select(F.col("a_id").alias("anchor_id"), F.col("p_id").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
                        F.col("p_score").alias("positive_score"), F.col("score").alias("negative_score"))
