"""Ranks, quantiles and order-based totals without a single-task sort.

Values are first collapsed to (group, value, count).  Cut points, read once from an approximate
quantile sketch, split the value range into buckets, more of them in sessions set up for more data;
cumulative counts are taken inside a bucket and shifted by the totals of the buckets below.  The cut
points only balance the work, so results are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

_UPTO = (Window.unboundedPreceding, Window.currentRow)
_BELOW = (Window.unboundedPreceding, -1)


def bucket_count(spark) -> int:
    """Buckets of the value range: as many as the session's shuffles have partitions, 64 to 4096.

    A bucket's running total is one window partition, so it has to shrink as the data grows; the shuffle setting is what says
    how much data there is.  The upper bound keeps the cut points a small list.
    """
    return min(4096, max(64, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def cut_points(df: DataFrame, col: str, n: int | None = None) -> list[float]:
    """At most ``n-1`` ascending values that split ``col`` into similar shares."""
    n = n or bucket_count(df.sparkSession)
    probe = df.select(F.col(col).cast("double").alias("v"))
    got = probe.approxQuantile("v", [i / n for i in range(1, n)], min(0.005, 0.3 / n))
    return sorted({float(x) for x in got if x == x})


def bucket_of(c: Column, cuts: list[float]) -> Column:
    """Index of the bucket of a value: a balanced tree of comparisons, so it stays in codegen."""
    c = c.cast("double")

    def node(lo: int, hi: int) -> Column:
        if lo >= hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(c <= cuts[mid], node(lo, mid)).otherwise(node(mid + 1, hi))

    return node(0, len(cuts))


def value_counts_scan(
    df: DataFrame,
    col: str,
    by=(),
    totals: dict[str, Column] | None = None,
    cuts: list[float] | None = None,
) -> DataFrame:
    """One row per (by, value) with running totals below that value.

    ``totals`` maps names to aggregates that add up (sum or count); each name ``x`` gives ``x``
    (at the value), ``x_below`` (strictly smaller values) and ``x_all`` (whole group).
    """
    by = [by] if isinstance(by, str) else list(by)
    totals = totals or {"n": F.count(F.lit(1))}
    if cuts is None:
        cuts = cut_points(df, col)
    g = (
        df.where(F.col(col).isNotNull())
        .groupBy(*by, col)
        .agg(*[e.alias(n) for n, e in totals.items()])
        .withColumn("_b", bucket_of(F.col(col), cuts))
    )
    per_bucket = g.groupBy(*by, "_b").agg(*[F.sum(n).alias(f"_s_{n}") for n in totals])
    # at most len(cuts)+1 rows per group
    w = Window.partitionBy(*by).orderBy("_b") if by else Window.partitionBy(F.lit(0)).orderBy("_b")
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    per_bucket = per_bucket.select(
        *[F.col(k).alias(f"_k_{k}") for k in by],
        F.col("_b").alias("_kb"),
        *[F.coalesce(F.sum(f"_s_{n}").over(w.rowsBetween(*_BELOW)), F.lit(0)).alias(f"_c_{n}") for n in totals],
        *[F.sum(f"_s_{n}").over(whole).alias(f"{n}_all") for n in totals],
    )
    on = F.col("_b") == F.col("_kb")
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = Window.partitionBy(*by, "_b").orderBy(col).rowsBetween(*_BELOW)
    j = g.join(per_bucket, on)
    j = j.withColumns({f"{n}_below": F.col(f"_c_{n}") + F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in totals})
    return j.drop("_b", "_kb", *[f"_k_{k}" for k in by], *[f"_c_{n}" for n in totals])


def quantiles(df: DataFrame, col: str, qs: list[float], by=(), names: list[str] | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles, one row per group (one row in all without ``by``)."""
    by = [by] if isinstance(by, str) else list(by)
    names = names or [f"q{str(q).replace('.', '_')}" for q in qs]
    s = value_counts_scan(df, col, by)
    v, lo, n, tot = F.col(col).cast("double"), F.col("n_below"), F.col("n"), F.col("n_all")
    aggs = []
    for i, q in enumerate(qs):
        pos = F.lit(float(q)) * (tot - 1)
        at = F.floor(pos)
        up = F.ceil(pos)
        aggs += [
            F.max(F.when((lo <= at) & (at < lo + n), v)).alias(f"_a{i}"),
            F.max(F.when((lo <= up) & (up < lo + n), v)).alias(f"_z{i}"),
            F.max(pos - at).alias(f"_f{i}"),
        ]
    g = s.groupBy(*by).agg(*aggs)
    return g.select(
        *by,
        *[
            (F.col(f"_a{i}") + (F.col(f"_z{i}") - F.col(f"_a{i}")) * F.col(f"_f{i}")).alias(names[i])
            for i in range(len(qs))
        ],
    )


def join_scan(df: DataFrame, scan: DataFrame, col: str, by=()) -> DataFrame:
    """Bring scan columns back to the rows that hold the value."""
    by = [by] if isinstance(by, str) else list(by)
    extra = [c for c in scan.columns if c not in (*by, col)]
    s = scan.select(*[F.col(k).alias(f"_k_{k}") for k in (*by, col)], *extra)
    on = F.col(col) == F.col(f"_k_{col}")
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(s, on, "left").drop(*[f"_k_{k}" for k in (*by, col)])


def kth(df: DataFrame, col: str, k) -> tuple | None:
    """(value, rows below it, rows at it) of the 0-based k-th smallest value; three numbers reach the driver.

    ``k`` may be a function of the column holding the number of rows.
    """
    s = value_counts_scan(df, col)
    at = k(F.col("n_all")) if callable(k) else F.lit(k)
    row = s.where((F.col("n_below") <= at) & (at < F.col("n_below") + F.col("n"))).select(
        F.col(col).alias("v"), "n_below", "n", at.cast("bigint").alias("k")).first()
    return None if row is None else tuple(row)
