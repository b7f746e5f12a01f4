"""Y: time-series operators over many keyed series.

A series holds one row per period, so it is bounded by its calendar, not by the raw data: raw rows
are resampled (Y01) with map-side combining before any per-series window or fold.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .aggregate import t_quantile_975
from .evaluate import regression_errors
from .joins import range_join
from .sampling import ts_cv
from .timeline import prior


def _keys(k) -> list[str]:
    return [] if k is None else [k] if isinstance(k, str) else list(k)


def _w(key, t):
    return Window.partitionBy(*_keys(key)).orderBy(t)


def resample(df, key, ts, freq, aggs: dict[str, Column], out="period") -> DataFrame:
    """Aggregate to a coarser period."""
    return df.groupBy(*_keys(key), F.date_trunc(freq, ts).alias(out)).agg(*[c.alias(n) for n, c in aggs.items()])


def aggregate_keys(df, keys, t, v) -> DataFrame:
    """Sum over the keys that are not listed."""
    return df.groupBy(*_keys(keys), t).agg(F.sum(v).alias(v))


def lag_pairs(df, key, t, v, lags=range(1, 17)) -> DataFrame:
    """(value, value lag periods before) for every lag, from one window pass."""
    w = _w(key, t)
    d = df.withColumns({f"_l{k}": F.lag(v, k).over(w) for k in lags})
    arr = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_l{k}").alias("lagged")) for k in lags])
    d = d.select(*_keys(key), t, F.col(v).alias("value"), F.explode(arr).alias("p"))
    return d.select(*_keys(key), t, "value", "p.*").where("lagged IS NOT NULL")


def acf(df, key, t, v, max_lag) -> DataFrame:
    """Autocorrelation with the full-series mean and divisor n, and the +-1.96/sqrt(n) bound."""
    keys = _keys(key)
    w = _w(keys, t)
    d = df.withColumn("_x", F.col(v) - F.avg(v).over(Window.partitionBy(*keys)))
    d = d.select(*keys, "_x", *[F.lag("_x", k).over(w).alias(f"_l{k}") for k in range(1, max_lag + 1)])
    g = d.groupBy(*keys).agg(
        F.count("_x").alias("n"),
        F.array(*[F.sum(F.col("_x") * F.col(f"_l{k}")) / F.sum(F.col("_x") * F.col("_x")) for k in range(1, max_lag + 1)]).alias("r"))
    return g.select(*keys, "n", F.posexplode("r").alias("lag", "acf")).select(
        *keys, (F.col("lag") + 1).alias("lag"), "acf", "n", (1.959963984540054 / F.sqrt("n")).alias("bound"))


def _acf_array(df, key, t, v, max_lag):
    a = acf(df, key, t, v, max_lag)
    return a.groupBy(*_keys(key)).agg(
        F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("lag", "acf"))), lambda s: s["acf"]).alias("r"))


def pacf(df, key, t, v, max_lag) -> DataFrame:
    """Partial autocorrelation by the Durbin-Levinson recursion, a fold over the ACF array."""
    g = _acf_array(df, key, t, v, max_lag)
    start = F.struct(F.array(F.get("r", F.lit(0))).alias("phi"), F.array(F.get("r", F.lit(0))).alias("out"))

    def step(acc, k):
        phi = acc["phi"]
        r = F.slice("r", 1, k - 1)
        num = F.get(F.col("r"), k - 1) - F.aggregate(F.zip_with(phi, F.reverse(r), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        den = 1 - F.aggregate(F.zip_with(phi, r, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        last = num / den
        new = F.concat(F.zip_with(phi, F.reverse(phi), lambda a, b: a - last * b), F.array(last))
        return F.struct(new.alias("phi"), F.concat(acc["out"], F.array(last)).alias("out"))

    ks = F.sequence(F.lit(2), F.lit(max_lag)) if max_lag >= 2 else F.array().cast("array<int>")
    g = g.select(*_keys(key), F.aggregate(ks, start, step)["out"].alias("p"))
    return g.select(*_keys(key), F.posexplode("p").alias("lag", "pacf")).withColumn("lag", F.col("lag") + 1)


def difference(df, key, t, v, lag=1, log=False, out="diff") -> DataFrame:
    """(seasonal) difference, on logs when asked."""
    x = F.ln(v) if log else F.col(v)
    return df.withColumn(out, x - F.lag(x, lag).over(_w(key, t)))


def decompose(df, key, t, v, m, kind="additive", season: Column | None = None) -> DataFrame:
    """Classical decomposition: centred moving average, normalised seasonal means, remainder.

    ``season`` is the season index column, by default the row position modulo m.
    """
    keys = _keys(key)
    w = _w(keys, t)
    h = m // 2
    full = F.count(v).over(w.rowsBetween(-h, h)) == 2 * h + 1
    if m % 2 == 0:
        inner = F.sum(v).over(w.rowsBetween(-(h - 1), h - 1))
        trend = (inner + (F.lag(v, h).over(w) + F.lead(v, h).over(w)) / 2) / m
    else:
        trend = F.avg(v).over(w.rowsBetween(-h, h))
    d = df.withColumn("trend", F.when(full, trend))
    d = d.withColumn("_s", season if season is not None else (F.row_number().over(w) - 1) % m)
    add = kind == "additive"
    d = d.withColumn("_dt", F.col(v) - F.col("trend") if add else F.col(v) / F.col("trend"))
    s = d.groupBy(*keys, "_s").agg(F.avg("_dt").alias("_raw"))  # m rows per series
    mean = F.avg("_raw").over(Window.partitionBy(*keys))
    s = s.withColumn("seasonal", F.col("_raw") - mean if add else F.col("_raw") / mean).drop("_raw")
    d = d.join(s, [*keys, "_s"])
    rem = F.col(v) - F.col("trend") - F.col("seasonal") if add else F.col(v) / (F.col("trend") * F.col("seasonal"))
    return d.withColumn("remainder", rem).drop("_s", "_dt")


def seasonal_table(df, key, month, year, v, years) -> DataFrame:
    """Season by year table with the sub-series mean."""
    g = df.groupBy(*_keys(key), month).pivot(year, years).agg(F.sum(v))
    means = df.groupBy(*_keys(key), month).agg(F.avg(v).alias("season_mean"))
    return g.join(means, [*_keys(key), month])


def chi2_sf(x: Column, dof: int) -> Column:
    """Upper tail of chi-square: 1 - P(dof/2, x/2), the lower series summed as a fold."""
    a, h = dof / 2, x / 2
    start = F.struct(F.lit(1.0 / a).alias("term"), F.lit(1.0 / a).alias("sum"))

    def step(acc, i):
        term = acc["term"] * h / (a + i)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(400)), start, step)["sum"]
    low = F.exp(a * F.ln(h) - h - math.lgamma(a)) * series
    return F.when(x <= 0, 1.0).when(h > 300, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - low))


def ljung_box(df, key, t, v, lags, dof=0) -> DataFrame:
    """n(n+2) sum r_k^2/(n-k) and its chi-square p-value with lags - dof degrees of freedom."""
    a = acf(df, key, t, v, lags)
    n = F.col("n")
    g = a.groupBy(*_keys(key)).agg(F.sum(n * (n + 2) * F.col("acf") * F.col("acf") / (n - F.col("lag"))).alias("stat"))
    return g.withColumn("p_value", chi2_sf(F.col("stat"), lags - dof))


def kpss(df, key, t, v, lags, null="level") -> DataFrame:
    """KPSS statistic with a Bartlett long-run variance over ``lags`` lags."""
    keys = _keys(key)
    w, whole = _w(keys, t), Window.partitionBy(*keys)
    d = df.withColumn("_i", F.row_number().over(w).cast("double"))
    if null == "level":
        d = d.withColumn("_e", F.col(v) - F.avg(v).over(whole))
    else:
        d = d.withColumns({"_b": F.regr_slope(v, "_i").over(whole), "_a": F.regr_intercept(v, "_i").over(whole)})
        d = d.withColumn("_e", F.col(v) - F.col("_a") - F.col("_b") * F.col("_i"))
    d = d.select(*keys, "_e", F.sum("_e").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_s"),
                 *[F.lag("_e", k).over(w).alias(f"_l{k}") for k in range(1, lags + 1)])
    lr = F.sum(F.col("_e") * F.col("_e"))
    for k in range(1, lags + 1):
        lr = lr + 2 * (1 - k / (lags + 1)) * F.sum(F.col("_e") * F.col(f"_l{k}"))
    n = F.count("_e")
    return d.groupBy(*keys).agg((F.sum(F.col("_s") * F.col("_s")) / (n * n) / (lr / n)).alias("kpss"), n.alias("n"))


def grouped_ols(df, key, y: Column, xs: dict[str, Column]) -> DataFrame:
    """Least squares per key with intercept: (key, term, beta, se, t, n, r2, sigma).

    Means and co-moments are aggregated with map-side combining, so large levels do not cancel them; only the
    small normal equations of a key, scaled to correlations, reach numpy.
    """
    keys = _keys(key)
    names = ["(intercept)", *xs]
    d = df.select(*keys, y.cast("double").alias("_y"),
                  *[c.cast("double").alias(f"_x{i + 1}") for i, c in enumerate(xs.values())]).dropna()
    p = len(names)
    cols = [f"_x{i}" for i in range(1, p)]
    g = d.groupBy(*keys).agg(
        F.array(*[F.covar_pop(a, b) for i, a in enumerate(cols) for b in cols[i:]]).cast("array<double>").alias("_xx"),
        F.array(*[F.covar_pop(a, "_y") for a in cols]).cast("array<double>").alias("_xy"),
        F.array(*[F.avg(a) for a in cols]).cast("array<double>").alias("_mx"),
        F.var_pop("_y").alias("_yy"), F.avg("_y").alias("_my"), F.count("_y").alias("n"))
    out = "struct<beta:array<double>,se:array<double>,r2:double,sigma:double>"

    @F.pandas_udf(out)
    def solve(xx: pd.Series, xy: pd.Series, mx: pd.Series, yy: pd.Series, my: pd.Series, n: pd.Series) -> pd.DataFrame:
        rows = []
        iu = np.triu_indices(p - 1)
        for a, b, mean, s2, mid, m in zip(xx, xy, mx, yy, my, n):
            mat = np.zeros((p - 1, p - 1))
            mat[iu] = a
            mat = mat + np.triu(mat, 1).T
            unit = np.sqrt(np.maximum(np.diag(mat), 0))
            unit = np.divide(1, unit, out=np.zeros_like(unit), where=unit > 0)  # a constant column has no slope
            inv = np.linalg.pinv(mat * np.outer(unit, unit), rcond=1e-13, hermitian=True) * np.outer(unit, unit)
            b, mean = np.asarray(b, dtype=float), np.asarray(mean, dtype=float)
            slope = inv @ b
            rss = max(float(s2 - slope @ b), 0.0) * m
            sig2 = rss / (m - p) if m > p else np.nan
            beta = np.concatenate([[mid - slope @ mean], slope])
            spread = np.concatenate([[1 + mean @ inv @ mean], np.maximum(np.diag(inv), 0)]) / m
            rows.append((beta, np.sqrt(spread * sig2), 1 - rss / (s2 * m) if s2 > 0 else np.nan, np.sqrt(sig2)))
        return pd.DataFrame(rows, columns=["beta", "se", "r2", "sigma"])

    g = g.withColumn("_f", solve("_xx", "_xy", "_mx", "_yy", "_my", "n"))
    terms = F.transform(
        F.arrays_zip(F.array(*[F.lit(x) for x in names]).alias("term"), F.col("_f.beta").alias("beta"), F.col("_f.se").alias("se")),
        lambda z: z)
    d = g.select(*keys, "n", F.col("_f.r2").alias("r2"), F.col("_f.sigma").alias("sigma"), F.explode(terms).alias("z"))
    return d.select(*keys, "z.*", (F.col("z.beta") / F.nullif(F.col("z.se"), F.lit(0.0))).alias("t"), "n", "r2", "sigma")


# fixed values: asymptotic 1, 5 and 10 % critical values
ADF_CRITICAL = {"const": (-3.43, -2.86, -2.57), "trend": (-3.96, -3.41, -3.13)}


def adf(df, key, t, v, k, regression="const") -> DataFrame:
    """T-statistic of the lagged level in the augmented Dickey-Fuller regression with k lags."""
    w = _w(key, t)
    d = df.withColumn("_d", F.col(v) - F.lag(v).over(w)).withColumn("_lvl", F.lag(v).over(w))
    d = d.withColumns({f"_d{i}": F.lag("_d", i).over(w) for i in range(1, k + 1)} | {"_i": F.row_number().over(w)})
    xs = {"level": F.col("_lvl")} | {f"d{i}": F.col(f"_d{i}") for i in range(1, k + 1)}
    if regression == "trend":
        xs["trend"] = F.col("_i")
    r = grouped_ols(d, key, F.col("_d"), xs).where(F.col("term") == "level")
    c1, c5, c10 = ADF_CRITICAL[regression]
    return r.select(*_keys(key), F.col("t").alias("adf"), "n", F.lit(c5).alias("crit_5pct"), (F.col("t") < c5).cast("int").alias("stationary"))


def benchmark_forecast(df, key, t, v, h, m=1, methods=("mean", "naive", "drift", "snaive")) -> DataFrame:
    """Forecasts 1..h steps ahead of an integer period index."""
    keys = _keys(key)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(t).desc()))
    d = df.withColumn("_back", rank)
    tail = F.sort_array(F.collect_list(F.when(F.col("_back") <= m, F.struct(t, v))))  # m values per series
    g = d.groupBy(*keys).agg(
        F.avg(v).alias("_mean"), F.max_by(v, t).alias("_last"), F.min_by(v, t).alias("_first"), F.max(t).alias("_t"),
        F.count(v).alias("_n"), F.transform(tail, lambda s: s[v]).alias("_tail"))
    g = g.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(h))))
    value = {
        "mean": F.col("_mean"), "naive": F.col("_last"),
        "drift": F.col("_last") + F.col("h") * (F.col("_last") - F.col("_first")) / (F.col("_n") - 1),
        "snaive": F.get("_tail", (F.col("h") - 1) % F.lit(m)),
    }
    arr = F.array(*[F.struct(F.lit(x).alias("method"), value[x].alias("forecast")) for x in methods])
    d = g.select(*keys, (F.col("_t") + F.col("h")).alias(t), "h", F.explode(arr).alias("f"))
    return d.select(*keys, t, "h", "f.*")


def forecast_accuracy(fc, actual, train, key, t, v, m=1) -> DataFrame:
    """Errors per method on the holdout; MASE scales by the in-sample (seasonal) naive MAE."""
    keys = _keys(key)
    w = _w(keys, t)
    sc = train.withColumn("_e", F.abs(F.col(v) - F.lag(v, m).over(w))).groupBy(*keys).agg(F.avg("_e").alias("_scale"))
    j = fc.join(actual.select(*keys, t, v), [*keys, t]).join(sc, keys)
    return regression_errors(j, v, "forecast", [*keys, "method"], F.col("_scale"))


def trend_season_regression(df, key, t, v, season, seasons, events: dict[str, Column] | None = None) -> DataFrame:
    """Log-linear trend with season dummies (first season is the base) and event flags.

    ``pct_effect`` is (exp(beta) - 1) * 100.
    """
    xs = {"trend": F.col(t)}
    xs |= {f"season_{s}": (F.col(season) == s).cast("int") for s in list(seasons)[1:]}
    xs |= {n: c.cast("int") for n, c in (events or {}).items()}
    return grouped_ols(df, key, F.ln(v), xs).withColumn("pct_effect", F.expm1("beta") * 100)


def piecewise_trend(df, key, t, v, knots) -> DataFrame:
    """Linear trend whose slope changes at the knots (hinge terms)."""
    xs = {"trend": F.col(t)} | {f"knot_{k}": F.greatest(F.col(t) - k, F.lit(0)) for k in knots}
    return grouped_ols(df, key, F.col(v), xs)


def scenario_predict(df, key, y, x, scenarios: dict[str, float]) -> DataFrame:
    """Regression prediction with a 95 % interval at each named scenario value."""
    keys = _keys(key)
    g = df.groupBy(*keys).agg(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"),
        F.regr_avgx(y, x).alias("mx"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"),
        F.regr_sxy(y, x).alias("sxy")).where("n > 2")
    arr = F.array(*[F.struct(F.lit(k).alias("scenario"), F.lit(float(x0)).alias("x0")) for k, x0 in scenarios.items()])
    d = g.withColumn("s", F.explode(arr)).select("*", "s.*")
    s2 = (F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")) / (F.col("n") - 2)
    gap = F.col("x0") - F.col("mx")
    half = t_quantile_975(F.col("n") - 2) * F.sqrt(s2 * (1 + 1 / F.col("n") + gap * gap / F.col("sxx")))
    fit = F.col("a") + F.col("b") * F.col("x0")
    return d.select(*keys, "scenario", fit.alias("fit"), (fit - half).alias("lower"), (fit + half).alias("upper"))


def ets(df, key, t, v, kind="ses", h=1, m=1, alphas=(0.1, 0.3, 0.5, 0.7, 0.9), betas=(0.1, 0.3), gammas=(0.1, 0.3),
        phi=0.9, multiplicative=False) -> DataFrame:
    """Exponential smoothing (ses, holt, damped, hw) with the grid point of least squared error.

    One fold per (series, grid point) over the sorted values; a series holds at most 10^5 periods.
    Returns the chosen parameters, the SSE and h forecasts.
    """
    keys = _keys(key)
    use_b, use_g = kind != "ses", kind == "hw"
    grid = [(a, b, g) for a in alphas for b in (betas if use_b else (0.0,)) for g in (gammas if use_g else (0.0,))]
    damp = phi if kind == "damped" else 1.0
    s = df.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(t, v))), lambda x: x[v].cast("double")).alias("_y"))
    s = s.where(F.size("_y") > (2 * m if use_g else 2))
    s = s.withColumn("_p", F.explode(F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(b).alias("beta"), F.lit(g).alias("gamma")) for a, b, g in grid])))
    s = s.select("*", "_p.*")
    a, b, g = F.col("alpha"), F.col("beta"), F.col("gamma")
    y0, y1 = F.get("_y", F.lit(0)), F.get("_y", F.lit(1))
    if use_g:
        first = F.slice("_y", 1, m)
        avg1 = F.aggregate(first, F.lit(0.0), lambda x, y: x + y) / m
        avg2 = F.aggregate(F.slice("_y", m + 1, m), F.lit(0.0), lambda x, y: x + y) / m
        level, trend = avg1, (avg2 - avg1) / m
        season = F.transform(first, lambda x: x / avg1 if multiplicative else x - avg1)
        rest = F.slice(F.col("_y"), F.lit(m + 1), F.size("_y") - m)
    else:
        level, trend = y0, (y1 - y0 if use_b else F.lit(0.0))
        season = F.array(F.lit(1.0 if multiplicative else 0.0))
        rest = F.slice(F.col("_y"), F.lit(2), F.size("_y") - 1)
    start = F.struct(level.alias("l"), trend.alias("b"), season.alias("s"), F.lit(0.0).alias("sse"))

    def step(st, y):
        l, tr, se = st["l"], st["b"], st["s"]
        s0 = F.get(se, F.lit(0))
        base = l + damp * tr
        fit = base * s0 if multiplicative else base + s0
        clean = (y / s0 if multiplicative else y - s0) if use_g else y
        nl = a * clean + (1 - a) * base
        nb = b * (nl - l) + (1 - b) * damp * tr if use_b else F.lit(0.0)
        if use_g:
            ns = g * (y / nl if multiplicative else y - nl) + (1 - g) * s0
            nse = F.concat(F.slice(se, 2, m - 1), F.array(ns)) if m > 1 else F.array(ns)
        else:
            nse = se
        e = y - fit
        return F.struct(nl.alias("l"), nb.alias("b"), nse.alias("s"), (st["sse"] + e * e).alias("sse"))

    s = s.withColumn("_st", F.aggregate(rest, start, step))
    best = s.groupBy(*keys).agg(F.min_by(F.struct("alpha", "beta", "gamma", "_st"), F.struct(F.col("_st.sse"), a, b, g)).alias("x"))
    best = best.select(*keys, "x.alpha", "x.beta", "x.gamma", F.col("x._st").alias("_st"))
    d = best.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(h))))
    if damp == 1.0:
        mult = F.col("h").cast("double")
    else:
        mult = damp * (1 - F.pow(F.lit(damp), F.col("h"))) / (1 - damp)
    base = F.col("_st.l") + mult * F.col("_st.b")
    s_h = F.get(F.col("_st.s"), (F.col("h") - 1) % F.lit(m if use_g else 1))
    fc = base * s_h if multiplicative else base + s_h
    return d.select(*keys, "alpha", "beta", "gamma", F.col("_st.sse").alias("sse"), "h", fc.alias("forecast"))


def forecast_cv(df, key, t, v, init, step, folds, h, m=1, methods=("mean", "naive", "drift")) -> DataFrame:
    """Expanding-window accuracy of the benchmark forecasts per method, over all folds."""
    keys = _keys(key)
    f = ts_cv(df, t, init, step, folds, h)
    train, test = f.where("role = 'train'"), f.where("role = 'test'")
    fk = [*keys, "fold"]
    fc = benchmark_forecast(train, fk, t, v, h, m, methods)
    j = fc.join(test.select(*fk, t, v), [*fk, t])
    return regression_errors(j, v, "forecast", [*keys, "method"])


def guerrero(df, key, t, v, m, grid=None) -> DataFrame:
    """Box-Cox lambda with the least variation of sd/mean^(1-lambda) over blocks of m periods."""
    keys = _keys(key)
    grid = grid or [round(-1 + 0.1 * i, 1) for i in range(31)]
    w = Window.partitionBy(*keys).orderBy(F.col(t).desc())
    # blocks are counted from the end, an incomplete first block is dropped
    d = df.withColumn("_blk", F.floor((F.row_number().over(w) - 1) / m))
    b = d.groupBy(*keys, "_blk").agg(F.avg(v).alias("_m"), F.stddev_samp(v).alias("_s"), F.count(v).alias("_n")).where(F.col("_n") == m)
    b = b.withColumn("lambda", F.explode(F.array(*[F.lit(float(x)) for x in grid])))
    b = b.withColumn("_r", F.col("_s") / F.pow("_m", 1 - F.col("lambda")))
    c = b.groupBy(*keys, "lambda").agg((F.stddev_samp("_r") / F.avg("_r")).alias("cv"))
    return c.groupBy(*keys).agg(F.min_by("lambda", F.when(F.col("cv").isNotNull(), F.struct("cv", "lambda"))).alias("lambda"), F.min("cv").alias("cv"))


def window_samples(df, key, t, v, width=80) -> DataFrame:
    """The last ``width`` values as features of the next one."""
    w = _w(key, t)
    d = df.withColumn("window", F.collect_list(v).over(w.rowsBetween(-width, -1)))
    return d.where(F.size("window") == width).select(*_keys(key), t, "window", F.col(v).alias("target"))


def mark_periods(df, sec, periods, lo, hi, order, out="in_period") -> DataFrame:
    """1 when the row lies in [lo, hi) of any period.

    Period starts and rows form one timeline; the latest end among earlier starts decides.
    """
    rows = df.select(F.col(sec).alias("_at"), F.lit(1).alias("_side"), F.struct(*df.columns).alias("_row"), F.lit(None).cast("bigint").alias("_hi"))
    marks = periods.select(F.col(lo).cast("bigint").alias("_at"), F.lit(0).alias("_side"), F.lit(None).alias("_row"), F.col(hi).cast("bigint").alias("_hi"))
    d = prior(rows.unionByName(marks), [], "_at", ("_at", "_side"), {"_end": ("max", F.col("_hi"))})
    d = d.where("_side = 1").withColumn(out, (F.coalesce(F.col("_end"), F.lit(-(2**62))) > F.col("_at")).cast("int"))
    return d.select("_row.*", out)
