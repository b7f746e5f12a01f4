"""A: grouped statistics.  Sums and counts combine map-side; exact quantiles go through ordering.py."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .joins import range_join
from .ordering import bucket_of, cut_points, quantiles
from .timeline import prior


def _keys(k) -> list[str]:
    return [] if k is None else [k] if isinstance(k, str) else list(k)


def group_size(df, key) -> DataFrame:
    """Rows per group."""
    return df.groupBy(*_keys(key)).agg(F.count(F.lit(1)).alias("n"))


def wallet_profile(df, key, amount, label, order, min_n=1) -> DataFrame:
    """Size, mean, max and first label per group, groups below ``min_n`` rows dropped."""
    g = df.groupBy(*_keys(key)).agg(
        F.count(F.lit(1)).alias("n"), F.avg(amount).alias("mean"), F.max(amount).alias("max"),
        F.min_by(label, order).alias("first"),
    )
    return g.where(F.col("n") >= min_n)


def describe_by(df, key, col) -> DataFrame:
    """Count, mean, std, min, quartiles and max per group; quartiles are exact."""
    keys = _keys(key)
    g = df.groupBy(*keys).agg(
        F.count(col).alias("count"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
        F.min(col).alias("min"), F.max(col).alias("max"),
    )
    return g.join(quantiles(df, col, [0.25, 0.5, 0.75], keys, ["p25", "p50", "p75"]), keys, "left")


def pivot_sum(df, idx, cat, val, values: list, fn="sum") -> DataFrame:
    """One column per category; missing cells are 0.  ``values`` fixes the columns, saving a pass."""
    f = {"sum": F.sum, "avg": F.avg}[fn]
    return df.groupBy(*_keys(idx)).pivot(cat, values).agg(f(val)).na.fill(0)


def unpivot(df, ids, cols, name="variable", value="value") -> DataFrame:
    """Columns to (name, value) rows in one pass."""
    return df.unpivot(_keys(ids), list(cols), name, value)


def stack_unstack(df, idx, cat, val, values) -> DataFrame:
    """Unstack a level to columns and stack it back, making absent cells explicit zeros."""
    return unpivot(pivot_sum(df, idx, cat, val, values), idx, values, cat, val)


def value_share(df, col) -> DataFrame:
    """Count and share of each value."""
    g = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return g.withColumn("share", F.col("n") / total)


def rate_by(df, keys, target) -> DataFrame:
    """Mean of the target and size per group."""
    return df.groupBy(*_keys(keys)).agg(F.avg(target).alias("rate"), F.count(target).alias("n"))


def corr_matrix(df, cols, by=()) -> DataFrame:
    """Correlation and sample covariance of every column pair, in one aggregation."""
    cells = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    by = _keys(by)
    g = df.groupBy(*by).agg(
        *[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(cells)],
        *[F.covar_samp(a, b).alias(f"c{i}") for i, (a, b) in enumerate(cells)],
    )
    rows = F.array(
        *[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"r{i}").alias("corr"), F.col(f"c{i}").alias("cov"))
          for i, (a, b) in enumerate(cells)]
    )
    return g.select(*by, F.explode(rows).alias("m")).select(*by, "m.*")


def first_differences(df, key, t, cols) -> DataFrame:
    """A09 on differences: v minus the value before, per bounded series."""
    w = Window.partitionBy(*_keys(key)).orderBy(t)
    return df.withColumns({c: F.col(c) - F.lag(c).over(w) for c in cols})


def corr_with(df, cols, target, flag=0.3) -> DataFrame:
    """A10: correlation of each column with the target and a flag for |r| above the bound."""
    g = df.agg(*[F.corr(c, target).alias(f"r{i}") for i, c in enumerate(cols)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"r{i}").alias("corr")) for i, c in enumerate(cols)])
    d = g.select(F.explode(rows).alias("m")).select("m.*")
    return d.withColumn("strong", (F.abs("corr") > flag).cast("int"))


def corr_with_time(df, key, t, v) -> DataFrame:
    """Correlation with the time index, for levels and for differences."""
    w = Window.partitionBy(*_keys(key)).orderBy(t)
    d = df.withColumn("_d", F.col(v) - F.lag(v).over(w))
    return d.groupBy(*_keys(key)).agg(F.corr(t, v).alias("corr_level"), F.corr(t, "_d").alias("corr_diff"))


def moments(df, cols, fat=3.0) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis per column, and a fat-tail flag."""
    parts = []
    for i, c in enumerate(cols):
        parts += [F.count(c).alias(f"n{i}"), F.skewness(c).alias(f"s{i}"), F.kurtosis(c).alias(f"k{i}")]
    g = df.agg(*parts)

    def cell(i, c):
        n, g1, g2 = F.col(f"n{i}"), F.col(f"s{i}"), F.col(f"k{i}")
        skew = F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))
        kurt = F.when(n > 3, ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3)))
        return F.struct(F.lit(c).alias("column"), skew.alias("skew"), kurt.alias("kurt"))

    d = g.select(F.explode(F.array(*[cell(i, c) for i, c in enumerate(cols)])).alias("m")).select("m.*")
    return d.withColumn("fat_tail", (F.col("kurt") > fat).cast("int"))


def _per_column(df, cols, by, cell, name) -> DataFrame:
    by = _keys(by)
    g = df.groupBy(*by).agg(*[cell(c).alias(f"_v{i}") for i, c in enumerate(cols)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_v{i}").alias(name)) for i, c in enumerate(cols)])
    return g.select(*by, F.explode(rows).alias("m")).select(*by, "m.*")


def zero_density(df, cols, split=None) -> DataFrame:
    """Share of (near) zero values per column, overall or per split."""
    return _per_column(df, cols, split, lambda c: F.avg((F.abs(c) < 1e-12).cast("int")), "zero_share")


def null_profile(df, cols=None, by=None) -> DataFrame:
    """Null share per column."""
    return _per_column(df, cols or df.columns, by, lambda c: F.avg(F.col(c).isNull().cast("int")), "null_share")


def quantile_table(df, cols, qs=(0.01, 0.05, 0.95, 0.99)) -> DataFrame:
    """Exact quantiles per column."""
    names = [f"p{round(q * 100):02d}" for q in qs]
    tabs = [quantiles(df, c, list(qs), names=names).select(F.lit(c).alias("column"), *names) for c in cols]
    return reduce(DataFrame.unionByName, tabs)


def mean_shift(df, cols, split, a, b, top=None) -> DataFrame:
    """|mean_b - mean_a| over the pooled deviation per column, or of the largest ``top`` columns."""
    parts = []
    for i, c in enumerate(cols):
        for tag, v in (("a", a), ("b", b)):
            x = F.when(F.col(split) == v, F.col(c))
            parts += [F.avg(x).alias(f"m{tag}{i}"), F.var_samp(x).alias(f"v{tag}{i}")]
    g = df.agg(*parts)
    cells = [
        F.struct(F.lit(c).alias("column"), (
            F.abs(F.col(f"mb{i}") - F.col(f"ma{i}")) / F.sqrt((F.col(f"va{i}") + F.col(f"vb{i}")) / 2)
        ).alias("shift"))
        for i, c in enumerate(cols)
    ]
    d = g.select(F.explode(F.array(*cells)).alias("m")).select("m.*")
    return d.orderBy(F.col("shift").desc(), "column").limit(top) if top else d


def n_distinct(df, col, by=None, approx=False) -> DataFrame:
    """Distinct count, exact or by sketch."""
    f = F.approx_count_distinct if approx else F.countDistinct
    return df.groupBy(*_keys(by)).agg(f(col).alias("n_distinct"))


def weighted_rating(df, votes, rating, pct=0.9) -> DataFrame:
    """v/(v+m)*R + m/(v+m)*C for rows with v >= m, m the pct-quantile of votes, C the mean rating."""
    m = quantiles(df, votes, [pct], names=["m"]).agg(F.max("m")).scalar()
    c = df.agg(F.avg(rating)).scalar()
    d = df.withColumns({"_m": m, "_c": c}).where(F.col(votes) >= F.col("_m"))
    v = F.col(votes)
    score = v / (v + F.col("_m")) * F.col(rating) + F.col("_m") / (v + F.col("_m")) * F.col("_c")
    return d.withColumn("score", score).drop("_m", "_c")


def ols_by(df, key, y, x) -> DataFrame:
    """Slope, intercept and R2 per group."""
    return df.groupBy(*_keys(key)).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"),
        F.regr_count(y, x).alias("n"),
    )


def ols_residuals(df, key, y, x, out="residual") -> DataFrame:
    """Residuals of the group regression; only the fitted coefficients are joined back."""
    keys = _keys(key)
    fit = ols_by(df, keys, y, x).select(*[F.col(k).alias(f"_k_{k}") for k in keys], "slope", "intercept")
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_k_{k}") for k in keys])
    d = df.join(fit, on, "left").withColumn(out, F.col(y) - (F.col("intercept") + F.col("slope") * F.col(x)))
    return d.drop(*[f"_k_{k}" for k in keys], "slope", "intercept")


# fixed values: two-sided 95 % Student quantiles for 1 to 10 degrees of freedom
T_975 = [12.706204736, 4.302652730, 3.182446305, 2.776445105, 2.570581836, 2.446911851, 2.364624252, 2.306004135, 2.262157163, 2.228138852]


def t_quantile_975(dof: Column) -> Column:
    """Table values up to 10 degrees of freedom, beyond them the Cornish-Fisher series around the normal quantile."""
    z = 1.959963984540054
    n = dof.cast("double")
    g = [
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]
    series = F.lit(z) + g[0] / n + g[1] / (n * n) + g[2] / F.pow(n, F.lit(3.0)) + g[3] / F.pow(n, F.lit(4.0))
    return F.coalesce(F.get(F.array(*[F.lit(t) for t in T_975]), dof.cast("int") - 1), series)


def ols_predict(df, key, y, x, x0) -> DataFrame:
    """Prediction at x0 with a 95 % prediction interval, from the group's sufficient statistics."""
    g = df.groupBy(*_keys(key)).agg(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"),
        F.regr_avgx(y, x).alias("mx"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"),
        F.regr_sxy(y, x).alias("sxy"),
    ).where(F.col("n") > 2)
    dof = F.col("n") - 2
    s2 = (F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")) / dof
    se = F.sqrt(s2 * (1 + 1 / F.col("n") + F.pow(F.lit(float(x0)) - F.col("mx"), F.lit(2.0)) / F.col("sxx")))
    fit = F.col("a") + F.col("b") * float(x0)
    half = t_quantile_975(dof) * se
    return g.select(*_keys(key), "n", fit.alias("fit"), (fit - half).alias("lower"), (fit + half).alias("upper"))


def monthly_returns(df, key, day, price) -> DataFrame:
    """First-to-last return per month, then mean, median and count per calendar month."""
    m = df.groupBy(*_keys(key), F.trunc(day, "month").alias("m")).agg(
        F.min_by(price, day).alias("a"), F.max_by(price, day).alias("z")
    ).withColumn("ret", F.col("z") / F.col("a") - 1)
    # one row per month: a bounded list for the median
    return m.groupBy(*_keys(key), F.month("m").alias("month")).agg(
        F.avg("ret").alias("mean"), F.median("ret").alias("median"), F.count("ret").alias("n"))


def dow_profile(df, key, day, v) -> DataFrame:
    """Mean, exact median and count per weekday (Monday = 0)."""
    d = df.withColumn("dow", F.weekday(day))
    keys = [*_keys(key), "dow"]
    g = d.groupBy(*keys).agg(F.avg(v).alias("mean"), F.count(v).alias("n"))
    return g.join(quantiles(d, v, [0.5], keys, ["median"]), keys)


def topn_share(df, key, val, n) -> DataFrame:
    """Total of the n largest keys, overall total and their ratio."""
    g = df.groupBy(key).agg(F.sum(val).alias("v"))
    total = g.agg(F.sum("v")).scalar()
    top = g.orderBy(F.col("v").desc(), key).limit(n).agg(F.sum("v").alias("top_total"))
    return top.select("top_total", total.alias("total"), (F.col("top_total") / total).alias("share"))


def change_summary(df, key, t, v) -> DataFrame:
    """First and last value in time, change and percent change per group."""
    g = df.groupBy(*_keys(key)).agg(F.min_by(v, t).alias("start"), F.max_by(v, t).alias("end"))
    ch = F.col("end") - F.col("start")
    return g.withColumns({"change": ch, "pct_change": F.when(F.col("start") != 0, ch / F.col("start") * 100)})


def boundary_gap(df, period, flag: Column, val) -> DataFrame:
    """Total per period with and without flagged rows, gap and covered share."""
    g = df.groupBy(period).agg(F.sum(val).alias("total"), F.sum(F.when(flag, F.col(val)).otherwise(0.0)).alias("covered"))
    return g.withColumns({"gap": F.col("total") - F.col("covered"), "coverage": F.col("covered") / F.col("total")})


def excluded_last(df, period, flag: Column, group, val) -> DataFrame:
    """Unflagged total per group in the last period."""
    last = df.agg(F.max(period)).scalar()
    return df.where((F.col(period) == last) & ~flag).groupBy(group).agg(F.sum(val).alias("excluded"))


def conditional_rates(df, key, flag, y) -> DataFrame:
    """Mean outcome of each group with the flag on and off, and their difference."""
    g = df.groupBy(*_keys(key)).agg(
        F.avg(F.when(F.col(flag) == 1, F.col(y))).alias("rate_1"),
        F.avg(F.when(F.col(flag) == 0, F.col(y))).alias("rate_0"),
    )
    return g.withColumn("diff", F.col("rate_1") - F.col("rate_0"))


def simpson_check(df, keys, sub, y) -> DataFrame:
    """Per group, the number of sub-cells, those without variance, and the spread of their means."""
    cells = df.groupBy(*_keys(keys), sub).agg(F.avg(y).alias("m"), F.stddev_samp(y).alias("s"), F.count(y).alias("n"))
    return cells.groupBy(*_keys(keys)).agg(
        F.count(F.lit(1)).alias("cells"), F.sum((F.coalesce("s", F.lit(0.0)) == 0).cast("int")).alias("zero_variance"),
        F.avg("m").alias("mean_of_means"), F.stddev_samp("m").alias("std_of_means"),
    )


def kyle_lambda(df, key, price, signed, sec, order, min_n=20) -> DataFrame:
    """Slope of the price change on sign(v)*sqrt(|v|) over the first half of each key's trades.

    0 below ``min_n`` points or without variance.  Audit only: it summarises the rows it is fitted on.
    """
    keys = _keys(key)
    d = prior(df, keys, sec, order, {"_i": ("count", F.lit(1)), "_p": ("lag", F.col(price))})
    n = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_n"))
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_k_{k}") for k in keys])
    d = d.join(n, on).where(F.col("_i") < F.floor(F.col("_n") / 2))
    dp = F.col(price) - F.col("_p")
    x = F.signum(signed) * F.sqrt(F.abs(F.col(signed)))
    g = d.withColumns({"_dp": dp, "_x": x}).groupBy(*keys).agg(
        F.regr_count("_dp", "_x").alias("n"), F.regr_slope("_dp", "_x").alias("_b"))
    return g.withColumn("kyle_lambda", F.when(F.col("n") >= min_n, F.coalesce("_b", F.lit(0.0))).otherwise(0.0)).drop("_b")


def bucket_dispersion(df, key, sec, price, minutes=5, prior_bucket=False, out="dispersion") -> DataFrame:
    """Deviation of prices inside (key, time bucket) on every row.

    ``prior_bucket`` uses the bucket before, which makes the feature causal.
    """
    keys = _keys(key)
    width = minutes * 60
    b = F.floor(F.col(sec) / width)
    g = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys], b.alias("_kb")).agg(F.stddev_samp(price).alias(out))
    if prior_bucket:
        g = g.withColumn("_kb", F.col("_kb") + 1)
    on = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"_k_{k}") for k in keys]) & (F.col("_b") == F.col("_kb"))
    return df.withColumn("_b", b).join(g, on, "left").drop("_b", "_kb", *[f"_k_{k}" for k in keys])


def mutual_info(df, cols, y, bins=10) -> DataFrame:
    """Mutual information with a binary target over quantile bins, in nats.

    Bin edges are exact quantiles, applied as scalars; only bin counts shuffle.
    """
    parts = []
    for c in cols:
        names = [f"e{i}" for i in range(1, bins)]
        e = quantiles(df, c, [i / bins for i in range(1, bins)], names=names).agg(F.max(F.array(*names))).scalar()
        d = df.select(F.col(c).alias("v"), F.col(y).alias("y")).withColumn("e", e)
        b = F.size(F.filter("e", lambda x: x < F.col("v")))
        g = d.where(F.col("v").isNotNull()).groupBy(b.alias("b"), "y").agg(F.count(F.lit(1)).alias("n"))
        n = F.sum("n").over(Window.partitionBy(F.lit(0)))  # at most 2*bins rows
        nb, ny = F.sum("n").over(Window.partitionBy("b")), F.sum("n").over(Window.partitionBy("y"))
        g = g.withColumn("t", F.col("n") / n * F.ln(F.col("n") * n / (nb * ny)))
        parts.append(g.agg(F.lit(c).alias("column"), F.sum("t").alias("mi")))
    return reduce(DataFrame.unionByName, parts)


def entropy_by(df, key, cat) -> DataFrame:
    """Entropy of the category distribution of each group."""
    keys = _keys(key)
    g = df.groupBy(*keys, cat).agg(F.count(F.lit(1)).alias("n"))
    # sum(-p ln p) = ln N - sum(n ln n)/N needs no second look at the cells
    return g.groupBy(*keys).agg((F.ln(F.sum("n")) - F.sum(F.col("n") * F.ln("n")) / F.sum("n")).alias("entropy"))


def event_window_counts(df, sec, amount, events, event_sec, event_id, hours=48) -> DataFrame:
    """Rows and volume per hour offset within +-hours of each event."""
    span = hours * 3600
    hourly = df.groupBy(F.floor(F.col(sec) / 3600).alias("_h")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(amount).alias("volume"))
    e = events.select(event_id, F.floor(F.col(event_sec) / 3600).alias("_e"))
    e = e.select(event_id, "_e", F.explode(F.sequence(F.col("_e") - hours, F.col("_e") + hours)).alias("_h"))
    return e.join(hourly, "_h").select(event_id, (F.col("_h") - F.col("_e")).alias("offset_hours"), "n", "volume")


def daily_volume(df, ts, amount) -> DataFrame:
    """Rows and volume per day."""
    return df.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("volume"))


def to_config_json(df, by, parts: dict[str, Column], out="config") -> DataFrame:
    """one nested JSON object per group; ``parts`` maps its names, in order, to aggregates: values, lists or structs.

    Lists gather a group, so groups should be of the size of a configuration.
    """
    g = df.groupBy(*_keys(by)).agg(*[c.alias(f"_p{i}") for i, c in enumerate(parts.values())])
    fields = [F.col(f"_p{i}").alias(n) for i, n in enumerate(parts)]
    return g.select(*_keys(by), F.to_json(F.struct(*fields)).alias(out))
