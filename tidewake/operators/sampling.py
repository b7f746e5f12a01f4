"""R: splits, folds, samples and bootstraps, all by hashes so a re-run chooses the same rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.scalars import unit_hash
from .ordering import bucket_count, join_scan, quantiles, value_counts_scan
from .ranking import top_fraction
from .timeline import prior


def _label(c: Column, cuts, names) -> Column:
    out = F.lit(names[-1])
    for cut, name in reversed(list(zip(cuts, names))):
        out = F.when(c <= cut, name).otherwise(out)
    return out


def split_by_time_quantile(df, ts, cuts=(0.7, 0.85), names=("train", "val", "test"), out="split") -> DataFrame:
    """Split at exact time quantiles, which reach the rows as scalars."""
    at = [f"_q{i}" for i in range(len(cuts))]
    q = quantiles(df, ts, list(cuts), names=at)
    e = q.agg(F.max(F.array(*at))).scalar()
    d = df.withColumn("_e", e)
    return d.withColumn(out, _label(F.col(ts), [F.get("_e", F.lit(i)) for i in range(len(cuts))], names)).drop("_e")


def split_chronological(df, ts, fractions=(0.8,), names=("train", "test"), out="split") -> DataFrame:
    """First fraction of the rows in time; rows of one instant stay together."""
    s = value_counts_scan(df, ts)
    pos = (F.col("n_below") + F.col("n")) / F.col("n_all")
    return join_scan(df, s.select(ts, _label(pos, [F.lit(f) for f in fractions], names).alias(out)), ts)


def split_by_cohort(df, cohorts, key, cohort_col, out="split") -> DataFrame:
    """Split label of the key's cohort; rows without a cohort are dropped."""
    return df.join(cohorts.select(key, F.col(cohort_col).alias(out)).distinct(), key)


def group_kfold(df, key, k=5, seed=0, out="fold") -> DataFrame:
    """All rows of a key share a fold."""
    return df.withColumn(out, F.floor(unit_hash(key, seed=seed) * k).cast("int"))


def stratified_kfold(df, y, uid, k=5, seed=0, out="fold") -> DataFrame:
    """Per class, rows dealt to the folds in hash order, so class sizes differ by at most one."""
    d = df.withColumn("_u", unit_hash(uid, seed=seed)).withColumn("_at", F.floor(F.col("_u") * (1 << 20)))
    d = prior(d, y, "_at", ("_u", uid), {"_i": ("count", F.lit(1))}, slice_secs=(1 << 20) // (4 * bucket_count(df.sparkSession)))
    return d.withColumn(out, (F.col("_i") % k).cast("int")).drop("_u", "_at", "_i")


def ts_cv(df, t, init, step, folds, horizon=None) -> DataFrame:
    """Expanding windows over an integer period index: fold f trains on t < init + f*step and
    tests on the next ``horizon`` (default step) periods.  Rows are listed once per fold they join."""
    horizon = horizon or step
    f = F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    d = df.withColumn("fold", f)
    origin = F.lit(init) + F.col("fold") * step
    role = F.when(F.col(t) < origin, "train").when(F.col(t) < origin + horizon, "test")
    return d.withColumn("role", role).where(F.col("role").isNotNull())


def sample_n(df, uid, n, seed=0) -> DataFrame:
    """min(n, N) rows with the smallest hashes, selected by a threshold."""
    d = df.withColumn("_u", -unit_hash(uid, seed=seed))
    return top_fraction(d, "_u", 1.0, uid, n).drop("_u")


def poisson_weight(u: Column) -> Column:
    """Poisson(1) draw from a uniform number."""
    cdf, total = [], 0.0
    for i in range(9):
        total += math.exp(-1) / math.factorial(i)
        cdf.append(total)
    c = F.lit(9)
    for i in range(8, -1, -1):
        c = F.when(u < cdf[i], i).otherwise(c)
    return c


# fixed values: modulus and multipliers of the replicate mixer, small enough for 64-bit products
_MOD, _STEP, _MULT = 2147483647, 1000003, (48271, 69621, 39373)


def replicate_uniform(base: Column, rep: Column) -> Column:
    """Uniform number per (row, replicate) from the row's hash: integer mixing, no text per replicate."""
    h = (base + rep * _STEP) % _MOD * _MULT[0] % _MOD
    h = h.bitwiseXOR(F.shiftright(h, 15)) * _MULT[1] % _MOD
    h = h.bitwiseXOR(F.shiftright(h, 13)) * _MULT[2] % _MOD
    return h / float(_MOD)


def with_replicates(df, uid, b, seed) -> DataFrame:
    """Each row b times, with columns rep and its Poisson weight _w (rows of weight 0 are left out)."""
    d = df.withColumn("_base", F.floor(unit_hash(uid, seed=seed) * _MOD))
    # the generator sits between the two steps, so the row hash is computed once per row
    d = d.withColumn("rep", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(b).cast("bigint"))))
    d = d.withColumn("_u", replicate_uniform(F.col("_base"), F.col("rep")))
    return d.withColumn("_w", poisson_weight(F.col("_u"))).where("_w > 0").drop("_base", "_u")


def _replicates(df, uid, b, seed, sums: dict[str, Column]) -> DataFrame:
    """Weighted sums per replicate; they combine map-side, so b rows per task shuffle."""
    d = df.select(F.col(uid).alias("_id"), *[e.alias(n) for n, e in sums.items()])
    d = with_replicates(d, "_id", b, seed)
    return d.groupBy("rep").agg(*[F.sum(F.col(n) * F.col("_w")).alias(n) for n in sums])


def _ci(reps, value: Column) -> DataFrame:
    """Mean and 2.5/97.5 % of one value per replicate (b rows)."""
    v = reps.select(value.alias("v"))
    return v.agg(F.avg("v").alias("mean"), F.percentile("v", 0.025).alias("lo"), F.percentile("v", 0.975).alias("hi"))


def bootstrap_ci(df, uid, num: Column, den: Column | None = None, b=200, seed=0) -> DataFrame:
    """Poisson bootstrap of sum(num)/sum(den), by default the mean."""
    den = F.lit(1.0) if den is None else den
    return _ci(_replicates(df, uid, b, seed, {"num": num.cast("double"), "den": den.cast("double")}),
               F.col("num") / F.col("den"))


def cluster_bootstrap_ci(df, cluster, num: Column, den: Column | None = None, b=200, seed=0) -> DataFrame:
    """Whole clusters are resampled; rows are summed per cluster first."""
    den = F.lit(1.0) if den is None else den
    g = df.groupBy(cluster).agg(F.sum(num.cast("double")).alias("_n"), F.sum(den.cast("double")).alias("_d"))
    # few rows, b hashes each: spread them over all cores whatever their size
    g = g.repartition(df.sparkSession.sparkContext.defaultParallelism, cluster)
    return _ci(_replicates(g, cluster, b, seed, {"num": F.col("_n"), "den": F.col("_d")}), F.col("num") / F.col("den"))


def paired_bootstrap(df, uid, a: Column, c: Column, b=200, seed=0, comparisons=1) -> DataFrame:
    """Difference of two means under shared weights, two-sided p and its Bonferroni form."""
    r = _replicates(df, uid, b, seed, {"a": a.cast("double"), "c": c.cast("double"), "n": F.lit(1.0)})
    r = r.select(((F.col("a") - F.col("c")) / F.col("n")).alias("d"))
    below, above = F.avg((F.col("d") <= 0).cast("int")), F.avg((F.col("d") >= 0).cast("int"))
    p = F.least(F.lit(1.0), 2 * F.least(below, above))
    g = r.agg(F.avg("d").alias("diff"), F.percentile("d", 0.025).alias("lo"), F.percentile("d", 0.975).alias("hi"),
              p.alias("p_value"))
    return g.withColumn("p_bonferroni", F.least(F.lit(1.0), F.col("p_value") * comparisons))


def random_baseline(df, uid, n, y, seeds) -> DataFrame:
    """Hit rate of n random rows, once per seed."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [
        sample_n(df, uid, n, s).agg(F.lit(s).alias("seed"), F.count(F.lit(1)).alias("n"), F.avg(y).alias("hit_rate"))
        for s in seeds])


def iqr_filter(df, col, factor=1.5, treat=None) -> DataFrame:
    """Rows inside [q1 - f*iqr, q3 + f*iqr]; ``treat='clip'`` bounds them instead of dropping."""
    q = quantiles(df, col, [0.25, 0.75], names=["a", "z"])
    st = q.agg(F.max(F.struct("a", "z"))).scalar()
    d = df.withColumn("_q", st)
    iqr = F.col("_q.z") - F.col("_q.a")
    lo, hi = F.col("_q.a") - factor * iqr, F.col("_q.z") + factor * iqr
    if treat == "clip":
        return d.withColumn(col, F.greatest(lo, F.least(hi, F.col(col)))).drop("_q")
    return d.where(F.col(col).between(lo, hi)).drop("_q")
