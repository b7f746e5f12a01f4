"""Q: data-quality and leakage checks; every check is a table of (check_name, passed, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from .aggregate import null_profile
from .joins import pit_event_features
from .sampling import sample_n
from .timeline import prior


def _keys(k) -> list[str]:
    return [k] if isinstance(k, str) else list(k)


def _result(df, name, ok: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(name).alias("check_name"), ok.cast("int").alias("passed"), detail.cast("double").alias("detail"))


def check_counts(df, expected: int, y, lo=0.0, hi=1.0) -> DataFrame:
    """Q01: row count as agreed and class share inside its bounds."""
    g = df.agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("rate"))
    return _result(g, "row_count", F.col("n") == expected, F.col("n")).unionByName(
        _result(g, "class_balance", F.col("rate").between(lo, hi), F.col("rate")))


def check_cutoff(df, ts, cutoff: Column, by) -> DataFrame:
    """Q02: rows at or after the group's cutoff; passes at 0."""
    return df.groupBy(*_keys(by)).agg(F.sum((F.col(ts) >= cutoff).cast("int")).alias("late_rows")).withColumn(
        "passed", (F.col("late_rows") == 0).cast("int"))


def check_forbidden(df, features: list[str], forbidden: list[str]) -> DataFrame:
    """Q03: forbidden names among the features."""
    rows = [(c, int(c not in features)) for c in sorted(forbidden)]
    return df.sparkSession.createDataFrame(rows, "column string, passed int")


def check_lag(df, key, v, stored, sec, order, default=None, need=0.995, tol=1e-6) -> DataFrame:
    """Q04: share of rows whose stored lag equals the recomputed one."""
    d = prior(df, key, sec, order, {"_lag": ("lag", F.col(v))})
    again = F.coalesce("_lag", F.lit(default)) if default is not None else F.col("_lag")
    same = F.when(again.isNull() | F.col(stored).isNull(), again.isNull() & F.col(stored).isNull()).otherwise(
        F.abs(again - F.col(stored)) < tol)
    g = d.agg(F.avg(same.cast("int")).alias("rate"))
    return _result(g, "lag_match", F.col("rate") >= need, F.col("rate"))


def check_point_in_time(df, events, key, sec, amount, uid, count_col, amount_col, n=None, need=0.99, seed=0) -> DataFrame:
    """Q05: stored point-in-time count and amount against a re-derivation of all rows, or of a hashed sample of ``n``."""
    s = pit_event_features(df if n is None else sample_n(df, uid, n, seed), events, key, sec, amount, "_re")
    ok = (F.col("_re_count") == F.col(count_col)) & (F.abs(F.col("_re_amount") - F.col(amount_col)) < 1e-4)
    g = s.agg(F.avg(ok.cast("int")).alias("rate"))
    return _result(g, "point_in_time", F.col("rate") >= need, F.col("rate"))


def check_alignment(a, b, keys, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Q06: keys missing on either side, and values that are null, NaN or outside their range."""
    keys = _keys(keys)
    j = a.select(*keys).withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), keys, "full")
    g = j.agg(
        F.sum((F.col("_a").isNull() | F.col("_b").isNull()).cast("int")).alias("unmatched"),
        *[F.sum((F.col(c).isNull() | F.isnan(c) | ~F.col(c).between(lo, hi)).cast("int")).alias(f"_{c}") for c, (lo, hi) in ranges.items()])
    parts = [_result(g, "unmatched_keys", F.col("unmatched") == 0, F.col("unmatched"))]
    parts += [_result(g, f"range_{c}", F.col(f"_{c}") == 0, F.col(f"_{c}")) for c in ranges]
    return reduce(DataFrame.unionByName, parts)


def check_first_row(df, key, sec, order, rules: dict[str, Column]) -> DataFrame:
    """Q07: rules that must hold on the first row of every key; counts the keys that break them."""
    d = prior(df, key, sec, order, {"_i": ("count", F.lit(1))}).where("_i = 0")
    g = d.agg(*[F.sum((~F.coalesce(c, F.lit(False))).cast("int")).alias(n) for n, c in rules.items()])
    return reduce(DataFrame.unionByName, [_result(g, n, F.col(n) == 0, F.col(n)) for n in rules])


def check_null_rates(df, bounds: dict[str, float]) -> DataFrame:
    """Q08: null share per column against its upper bound."""
    p = null_profile(df, list(bounds))
    lim = F.create_map(*[x for c, b in bounds.items() for x in (F.lit(c), F.lit(float(b)))])
    return p.withColumn("bound", lim[F.col("column")]).withColumn("passed", (F.col("null_share") <= F.col("bound")).cast("int"))


def check_structural_nulls(df, flag: Column, cols, non_negative=()) -> DataFrame:
    """Q09: rows without enrichment must have all its columns null; listed columns must not be negative."""
    g = df.agg(
        *[F.sum((~flag & F.col(c).isNotNull()).cast("int")).alias(f"filled_{c}") for c in cols],
        *[F.sum((F.col(c) < 0).cast("int")).alias(f"negative_{c}") for c in non_negative])
    names = [f"filled_{c}" for c in cols] + [f"negative_{c}" for c in non_negative]
    return reduce(DataFrame.unionByName, [_result(g, n, F.coalesce(F.col(n), F.lit(0)) == 0, F.coalesce(F.col(n), F.lit(0))) for n in names])


def check_duplicates(df, keys) -> DataFrame:
    """Q10: surplus rows and affected keys."""
    g = df.groupBy(*_keys(keys)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return g.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus_rows"), F.count(F.lit(1)).alias("duplicate_keys"))


def check_reconcile(df, dim, key, v, declared, lo=0.5, hi=1.5, min_declared=0.0) -> DataFrame:
    """Q11: keys whose summed volume is outside [lo, hi] times the declared one."""
    g = df.groupBy(*_keys(key)).agg(F.sum(v).alias("extracted"))
    j = dim.where(F.col(declared) > min_declared).join(g, _keys(key), "left")
    r = j.withColumn("ratio", F.coalesce("extracted", F.lit(0.0)) / F.col(declared))
    return r.where(~F.col("ratio").between(lo, hi)).select(*_keys(key), "ratio")


def check_domain(df, col, allowed) -> DataFrame:
    """Q12: values outside the allowed set, with their counts."""
    return df.where(F.col(col).isNull() | ~F.col(col).isin(list(allowed))).groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def repair_report(before, after, key, col) -> DataFrame:
    """Q13: transition counts of a 0/1 flag, rows changed and the change of its mean."""
    j = before.select(*_keys(key), F.col(col).alias("b")).join(after.select(*_keys(key), F.col(col).alias("a")), _keys(key))
    n = lambda x, y: F.sum(((F.col("b") == x) & (F.col("a") == y)).cast("int"))
    return j.agg(n(1, 0).alias("n_1_0"), n(1, 1).alias("n_1_1"), n(0, 1).alias("n_0_1"),
                 F.sum((~F.col("b").eqNullSafe(F.col("a"))).cast("int")).alias("changed"),
                 (F.avg("a") - F.avg("b")).alias("mean_change"))


def check_schema(df, schema: str | StructType) -> DataFrame:
    """Q14: required columns with expected and actual type."""
    want = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    have = dict(df.dtypes)
    rows = [(f.name, f.dataType.simpleString(), have.get(f.name), int(have.get(f.name) == f.dataType.simpleString())) for f in want]
    return df.sparkSession.createDataFrame(rows, "column string, expected string, actual string, passed int")
