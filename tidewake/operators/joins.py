"""J: equi, as-of, interval and pair joins.  Broadcast is left to the planner's size threshold."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from .timeline import prior


def _keys(k) -> list[str]:
    return [k] if isinstance(k, str) else list(k)


def join_dim(facts: DataFrame, dim: DataFrame, on, suffix="_dim") -> DataFrame:
    """Left join; dimension columns that clash with fact columns get a suffix."""
    on = _keys(on)
    clash = {c: f"{c}{suffix}" for c in dim.columns if c in facts.columns and c not in on}
    return facts.join(dim.withColumnsRenamed(clash), on, "left")


def align_inner(a: DataFrame, b: DataFrame, on, cols) -> DataFrame:
    """Inner join on the shared key, rows with a null in ``cols`` dropped."""
    return a.join(b, _keys(on), "inner").dropna(subset=list(cols))


def first_rows(df: DataFrame, keys, order) -> DataFrame:
    """First row per key as a map-side combined minimum, so a hot key never meets in one sort."""
    keys = _keys(keys)
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*_keys(order))).alias("_r"))
    return g.select(*keys, "_r.*").select(*df.columns)


def join_point_features(left: DataFrame, right: DataFrame, keys, order) -> DataFrame:
    """Left join on a composite key after the right side is reduced to one row per key."""
    return left.join(first_rows(right, keys, order), _keys(keys), "left")


def join_first_per_key(left: DataFrame, dim: DataFrame, key, order) -> DataFrame:
    """Left join against the first dimension row of each key."""
    return join_point_features(left, dim, key, order)


def asof_backward(
    left: DataFrame, right: DataFrame, by, sec: str, value: str, right_order, out="asof", strict=True,
    fallback: Column | None = None,
) -> DataFrame:
    """Last right value before each left row of the same key.

    Both sides become one timeline and the last value is a prior scan, so there is no range join.
    With ``strict`` a quote of the same second does not count.  Quotes of one second follow ``right_order``,
    columns of any type.
    """
    by, right_order = _keys(by), _keys(right_order)
    carried = [c for c in left.columns if c not in by]
    l_rank, r_rank = (0, 1) if strict else (1, 0)
    seq = F.struct(*right_order)
    kind = right.select(seq.alias("s")).schema["s"].dataType
    l = left.select(
        *by, F.col(sec).alias("_at"), F.lit(l_rank).alias("_side"), F.lit(None).cast(kind).alias("_seq"),
        F.struct(*carried).alias("_row"), F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"),
    )
    r = right.select(
        *by, F.col(sec).alias("_at"), F.lit(r_rank).alias("_side"), seq.alias("_seq"),
        F.lit(None).alias("_row"), F.col(value).alias("_v"),
    )
    both = l.unionByName(r)
    d = prior(both, by, "_at", ("_at", "_side", "_seq"), {"_last": ("last", F.col("_v"))})
    d = d.where(F.col("_side") == l_rank).select(*by, "_row.*", F.col("_last").alias(out))
    return d if fallback is None else d.withColumn(out, F.coalesce(F.col(out), fallback))


def pit_array_features(df: DataFrame, sec: str, times: str, amounts: str, out="pit") -> DataFrame:
    """Count and amount of array elements strictly before the row, age and days since the first.

    ``times`` is an ascending array per row; negative ages are null.
    """
    t = F.col(sec)
    pairs = F.filter(F.arrays_zip(F.col(times).alias("t"), F.col(amounts).alias("a")), lambda x: x["t"] < t)
    age = t - F.get(F.col(times), F.lit(0))
    return df.withColumns(
        {
            f"{out}_count": F.size(F.filter(times, lambda x: x < t)).cast("bigint"),
            f"{out}_amount": F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x["a"]),
            f"{out}_age": F.when(age >= 0, age),
            f"{out}_days": F.when(age >= 0, age / 86400),
        }
    )


def pit_event_features(trades: DataFrame, events: DataFrame, key: str, sec: str, amount: str, out="pit") -> DataFrame:
    """J06 for long histories: the same features from an event table instead of arrays."""
    carried = [c for c in trades.columns if c != key]
    l = trades.select(key, F.col(sec).alias("_at"), F.lit(0).alias("_side"), F.struct(*carried).alias("_row"),
                      F.lit(None).cast("double").alias("_a"), F.lit(None).cast("bigint").alias("_t"))
    r = events.select(key, F.col(sec).alias("_at"), F.lit(1).alias("_side"), F.lit(None).alias("_row"),
                      F.col(amount).cast("double").alias("_a"), F.col(sec).alias("_t"))
    d = prior(l.unionByName(r), key, "_at", ("_at", "_side"),
              {"_n": ("count", F.col("_t")), "_s": ("sum", F.col("_a")), "_f": ("min", F.col("_t"))})
    d = d.where("_side = 0")
    return d.select(
        key, "_row.*", F.col("_n").alias(f"{out}_count"), F.col("_s").alias(f"{out}_amount"),
        (F.col("_at") - F.col("_f")).alias(f"{out}_age"),
    )


def flag_in(df: DataFrame, keys_df: DataFrame, col: str, out="seen") -> DataFrame:
    """1 when the key occurs in the other table."""
    k = keys_df.select(F.col(col).alias("_k")).distinct().withColumn("_hit", F.lit(1))
    return df.join(k, F.col(col) == F.col("_k"), "left").withColumn(out, F.coalesce("_hit", F.lit(0))).drop("_k", "_hit")


def orphans(docs: DataFrame, members: DataFrame, on) -> DataFrame:
    """Rows without a partner."""
    return docs.join(members.select(*_keys(on)), _keys(on), "left_anti")


def range_join(
    points: DataFrame, intervals: DataFrame, key, at: str, lo: str, hi: str, width: int
) -> DataFrame:
    """Points inside [lo, hi) of intervals with the same key.

    Intervals are listed once per time bucket they touch, so the join is an equi-join on
    (key, bucket) with a residual range check; a hot key is spread over its buckets.
    """
    keys = _keys(key)
    p = points.withColumn("_b", F.floor(F.col(at) / width))
    i = intervals.where(F.col(hi) > F.col(lo)).withColumn(
        "_b", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width)))
    )
    j = p.join(i, [*keys, "_b"])
    return j.where((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("_b")


def param_grid(spark, **lists) -> DataFrame:
    """One row per combination of the listed parameter values (settings, not data)."""
    names = list(lists)
    return spark.createDataFrame([tuple(x) for x in product(*lists.values())], names)


def compare_runs(before: DataFrame, after: DataFrame, key: str, label: str) -> DataFrame:
    """Full outer join of two runs on the id, then counts per transition of the label."""
    b = before.select(key, F.col(label).alias("before"))
    a = after.select(key, F.col(label).alias("after"))
    j = b.join(a, key, "full")
    g = j.groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn(
        "transition", F.concat_ws(" -> ", F.coalesce("before", F.lit("(none)")), F.coalesce("after", F.lit("(none)")))
    )


def pairs(df: DataFrame, key: str, suffixes=("_a", "_b"), within: str | None = None) -> DataFrame:
    """Unordered pairs a < b of a *reduced* table (one row per class, feature or sector).

    With ``within`` pairs form only inside that column's groups, as an equi-join.
    """
    sa, sb = suffixes
    a = df.select(*[F.col(c).alias(c + sa) for c in df.columns])
    b = df.select(*[F.col(c).alias(c + sb) for c in df.columns])
    cond = F.col(key + sa) < F.col(key + sb)
    if within:
        cond = (F.col(within + sa) == F.col(within + sb)) & cond
    return a.join(b, cond)
