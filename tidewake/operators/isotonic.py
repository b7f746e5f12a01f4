"""Isotonic regression by pooling adjacent violators in slices of the score range.

Rows are first collapsed to one (score, sum, weight) per distinct score, combined map-side.  The range is cut into slices by a
quantile sketch; each slice pools its own violators, then neighbouring slices are merged ``FAN`` at a time, in order, until one is
left.  Blocks pooled inside a slice are pooled in the whole fit as well, so the result is that of one sequential pass, whatever the
slices; only blocks travel, never rows.  A fit of 0/1 labels has far fewer blocks than rows (at most in the order of n^(2/3)).

The model is a table of blocks; scores meet it by value buckets, so it is neither collected nor broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .ordering import bucket_of, cut_points

FAN = 16
_BLOCK = "lo double, hi double, total double, weight double"


def pool(lo, hi, total, weight):
    """Blocks of non-decreasing mean from blocks in order: adjacent ones are merged while the mean falls or stays."""
    out: list[list[float]] = []
    for a, b, s, w in zip(lo.tolist(), hi.tolist(), total.tolist(), weight.tolist()):
        while out and out[-1][2] * w >= s * out[-1][3]:
            a, _, s0, w0 = out.pop()
            s, w = s + s0, w + w0
        out.append([a, b, s, w])
    return [np.array(c) for c in zip(*out)] if out else [np.zeros(0)] * 4


def _merge(blocks: DataFrame, fan: int) -> DataFrame:
    """Blocks pooled over ``fan`` neighbouring slices."""

    def run(key, t):
        t = t.sort_by("lo")
        got = pool(*[t.column(c).to_numpy() for c in ("lo", "hi", "total", "weight")])
        return pa.table([pa.array(np.full(len(got[0]), key[0].as_py(), np.int32)), *map(pa.array, got)], names=["slice", "lo", "hi", "total", "weight"])

    d = blocks.withColumn("slice", F.floor(F.col("slice") / fan).cast("int"))
    return d.groupBy("slice").applyInArrow(run, f"slice int, {_BLOCK}")


def fit_isotonic(df: DataFrame, p: str, y: str, weight: str | None = None) -> DataFrame:
    """Blocks (lo, hi, value, weight, next_lo, next_value) of the least-squares non-decreasing fit of ``y`` on ``p``.

    Rows whose score, target or weight is null take no part, nor do weights of 0.  Equal scores share one value.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(F.col(p).cast("double").alias("lo"), F.col(y).cast("double").alias("_y"), w.alias("_w"))
    rows = rows.where("lo is not null and not isnan(lo) and _y is not null and _w > 0")
    each = rows.groupBy("lo").agg(F.sum(F.col("_y") * F.col("_w")).alias("total"), F.sum("_w").alias("weight"))
    cuts = cut_points(rows, "lo")
    blocks = each.select(bucket_of(F.col("lo"), cuts).alias("slice"), "lo", F.col("lo").alias("hi"), "total", "weight")
    blocks, slices = _merge(blocks, 1), len(cuts) + 1
    while slices > 1:
        blocks, slices = _merge(blocks, FAN), -(-slices // FAN)
    order = Window.partitionBy("slice").orderBy("lo")  # the blocks of the fit: one slice is left
    value = F.col("total") / F.col("weight")
    return cut_lineage(blocks.select("lo", "hi", value.alias("value"), "weight", F.lead("lo").over(order).alias("next_lo"), F.lead(value).over(order).alias("next_value")))


def apply_isotonic(model: DataFrame, df: DataFrame, p: str, out="p_cal", eps=1e-6) -> DataFrame:
    """Calibrated score, kept inside (eps, 1 - eps): a block's value inside it, linear between blocks, the first or last
    value beyond them.  Null scores stay null."""
    cuts = cut_points(model, "lo")
    x = F.col(p).cast("double")
    asked = df.select(x.alias("_x")).where("_x is not null").distinct().withColumn("b", F.lit(None).cast(model.select(F.struct("*").alias("b")).schema["b"].dataType))
    both = asked.unionByName(model.select(F.col("lo").alias("_x"), F.struct("*").alias("b")))
    both = both.withColumn("s", bucket_of(F.col("_x"), cuts))
    inside = Window.partitionBy("s").orderBy("_x", F.col("b").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = both.groupBy("s").agg(F.max_by("b", F.when(F.col("b").isNotNull(), F.col("_x"))).alias("top"))
    before = Window.partitionBy(F.lit(0)).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    per = per.select(F.col("s").alias("s0"), F.last("top", ignorenulls=True).over(before).alias("before"))
    both = both.withColumn("mine", F.last("b", ignorenulls=True).over(inside)).where("b is null")
    known = both.join(per, F.col("s") == F.col("s0")).withColumn("m", F.coalesce("mine", "before"))
    first = model.agg(F.min_by("value", "lo")).scalar()
    part = (F.col("_x") - F.col("m.hi")) / (F.col("m.next_lo") - F.col("m.hi"))
    between = F.col("m.value") + part * (F.col("m.next_value") - F.col("m.value"))
    got = F.when(F.col("m").isNull(), first).when((F.col("_x") <= F.col("m.hi")) | F.col("m.next_lo").isNull(), F.col("m.value")).otherwise(between)
    known = known.select("_x", F.greatest(F.lit(eps), F.least(F.lit(1 - eps), got)).alias(out))
    return df.drop(out).join(known, x == F.col("_x"), "left").drop("_x")
