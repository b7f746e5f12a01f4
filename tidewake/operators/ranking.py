"""K: top fractions, top-k and deterministic caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.scalars import unit_hash
from .joins import first_rows
from .ordering import kth


def _keys(k) -> list[str]:
    return [k] if isinstance(k, str) else list(k)


def top_fraction(df: DataFrame, score: str, pct: float, tiebreak: str, k: int | None = None) -> DataFrame:
    """The k = max(1, int(n*pct)) rows with the largest score, ties to the smaller id.

    The k-th score and, where its ties straddle the cut, the last id admitted at it are exact order
    statistics over collapsed values; the selection itself is a plain filter.
    """
    d = df.where(F.col(score).isNotNull()).withColumn("_neg", -F.col(score))
    if k is None:
        found = kth(d, "_neg", lambda n: F.greatest(F.lit(1), F.floor(n * F.lit(pct))) - 1)
    else:
        found = kth(d, "_neg", lambda n: F.least(F.lit(k), n) - 1)
    if found is None:
        return d.where(F.lit(False)).drop("_neg")
    cut, below, at, last = found
    if below + at == last + 1:
        return d.where(F.col("_neg") <= F.lit(cut)).drop("_neg")
    tie = kth(d.where(F.col("_neg") == F.lit(cut)), tiebreak, last - below)
    return d.where((F.col("_neg") < F.lit(cut)) | ((F.col("_neg") == F.lit(cut)) & (F.col(tiebreak) <= F.lit(tie[0])))).drop("_neg")


def top_groups(df: DataFrame, key: str, val: str, n: int) -> DataFrame:
    """The n groups with the largest total; a bounded TakeOrdered, not a full sort."""
    g = df.groupBy(key).agg(F.sum(val).alias("total"))
    return g.orderBy(F.col("total").desc(), key).limit(n)


def topk_by(df: DataFrame, key, score: str, tiebreak: str, k: int, out="rank", salts=32) -> DataFrame:
    """K best rows per group.  A salted first round cuts every group to at most k*salts rows."""
    keys = _keys(key)
    order = [F.col(score).desc(), F.col(tiebreak)]
    d = df.withColumn("_salt", F.pmod(F.xxhash64(tiebreak), F.lit(salts)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    d = d.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k).drop("_r", "_salt")
    w = Window.partitionBy(*keys).orderBy(*order)
    return d.withColumn(out, F.row_number().over(w).cast("bigint")).where(F.col(out) <= k)


def stable_sort(df: DataFrame, *keys: str, unique: str) -> DataFrame:
    """Sort by several keys, made total by a unique column (range-partitioned by Spark)."""
    return df.orderBy(*keys, unique)


def first_per_group(df: DataFrame, key, order) -> DataFrame:
    """First row of each group."""
    return first_rows(df, key, order)


def cap_per_group(df: DataFrame, key, uid: str, n: int, seed=0, salts=32) -> DataFrame:
    """At most n rows per group, chosen by a hash of the row id (same choice on every run)."""
    d = df.withColumn("_u", -unit_hash(uid, seed=seed))
    return topk_by(d, key, "_u", uid, n, "_rank", salts).drop("_u", "_rank")


def stride_per_group(df: DataFrame, key, sec: str, order, step: int) -> DataFrame:
    """Every ``step``-th row of each group in time order."""
    from .timeline import prior

    d = prior(df, key, sec, order, {"_i": ("count", F.lit(1))})
    return d.where(F.col("_i") % step == 0).drop("_i")
