"""B: set-based strategy and risk evaluation."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.scalars import clip, side_is_yes
from .ordering import quantiles
from .ranking import top_fraction
from .timeline import HOUR
from .windows import cum_return, drawdown, pct_rank

SIX_HOURS = 6 * HOUR


def _keys(k) -> list[str]:
    return [] if k is None else [k] if isinstance(k, str) else list(k)


def path_extremes(df, keys, sec, order, step: str, slice_secs=HOUR) -> DataFrame:
    """Total, lowest point and deepest fall of the running sum of ``step`` per key.

    The path is cut into time slices; each slice is reduced to (sum, highest, lowest, deepest fall)
    and slices are chained on their totals, so one key's rows never meet in one task.
    """
    keys = _keys(keys)
    d = df.withColumn("_sl", F.floor(F.col(sec) / slice_secs))
    w = Window.partitionBy(*keys, "_sl").orderBy(*_keys(order)).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_c", F.sum(step).over(w)).withColumn("_pk", F.max("_c").over(w))
    s = d.groupBy(*keys, "_sl").agg(
        F.sum(step).alias("_s"), F.max("_c").alias("_hi"), F.min("_c").alias("_lo"),
        F.max(F.col("_pk") - F.col("_c")).alias("_dd"))
    wk = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_sl").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_base", F.coalesce(F.sum("_s").over(wk), F.lit(0.0)))
    s = s.withColumn("_peak", F.max(F.col("_base") + F.col("_hi")).over(wk))
    fall = F.greatest(F.col("_dd"), F.col("_peak") - (F.col("_base") + F.col("_lo")))
    return s.groupBy(*keys).agg(
        F.sum("_s").alias("total"), F.min(F.col("_base") + F.col("_lo")).alias("lowest"), F.max(fall).alias("max_drawdown"))


def strategy_signals(df, uid, p_hat="p_hat", edge="edge", cost="cost", ttd="ttd") -> DataFrame:
    """One row per (strategy, trade) for the ten masks."""
    p, e, c, t = (F.col(x) for x in (p_hat, edge, cost, ttd))
    rules = {
        "phat_gt_0.99": p >= 0.99, "phat_gt_0.95": p >= 0.95, "phat_gt_0.9": p >= 0.90,
        "general_ev": e > 0.02, "general_ev_late": (e > 0.02) & (t < SIX_HOURS),
        "general_ev_cheap": (e > 0.02) & (c < 0.30),
        "home_run": (e > 0.20) & (c < 0.30) & (t < SIX_HOURS),
    }
    hits = F.array_compact(F.array(*[F.when(m, F.lit(n)) for n, m in rules.items()]))
    parts = [df.withColumn("strategy", F.explode(hits))]
    for name, score, pct in (("top1pct_phat", p_hat, 0.01), ("top1pct_edge", edge, 0.01), ("top5pct_edge", edge, 0.05)):
        parts.append(top_fraction(df, score, pct, uid).withColumn("strategy", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def pnl(cost, y, stake=100.0) -> Column:
    """Profit of a flat stake bought at ``cost``."""
    c = F.col(cost)
    return F.when(F.col(y) == 1, stake * (1 - c) / c).otherwise(-stake)


def flat_stake(df, cost, y, market, sec, order, by="strategy", stake=100.0) -> DataFrame:
    """Trades, hit rate, profit, Sharpe per trade, markets and max drawdown per strategy."""
    by = _keys(by)
    d = df.withColumn("_pnl", pnl(cost, y, stake))
    sd = F.stddev_pop("_pnl")
    g = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_trades"), F.avg(y).alias("hit_rate"), F.sum("_pnl").alias("total_pnl"),
        F.avg("_pnl").alias("mean_pnl"), F.when(sd > 0, F.avg("_pnl") / sd).alias("sharpe"),
        F.countDistinct(market).alias("n_markets"))
    dd = path_extremes(d, by, sec, order, "_pnl").select(*by, "max_drawdown")
    return g.join(dd, by)


def two_sided_trades(df, p_hat, mip, y, thr: Column, ttd=None, ttd_max=None, mip_max=None, floor=None,
                     slip: Column | None = None) -> DataFrame:
    """Gate and return per dollar: follow when p - mip > thr, inverse when below -thr.

    ``floor`` bounds the price in the payoff, ``slip`` worsens the price paid.
    """
    m = F.col(mip)
    edge = F.col(p_hat) - m
    follow, inverse = edge > thr, edge < -thr
    gate = follow | inverse
    if ttd_max is not None:
        gate = gate & (F.col(ttd) < ttd_max)
    if mip_max is not None:
        gate = gate & (m < mip_max)
    paid = F.when(follow, m).otherwise(1 - m)
    if floor is not None:
        paid = clip(paid, floor, 1 - floor)
    if slip is not None:
        paid = F.least(paid + slip, F.lit(0.999))
    won = F.when(follow, F.col(y)).otherwise(1 - F.col(y))
    return df.where(gate).withColumns({"follow": follow.cast("int"), "paid": paid, "ret": won / paid - 1})


def _rule_summary(d, by, sec, order, stake):
    by = _keys(by)
    d = d.withColumn("_pnl", F.col("ret") * stake)
    g = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("triggers"), F.sum("follow").alias("follows"),
        F.sum((F.col("ret") > 0).cast("int")).alias("wins"), F.avg((F.col("ret") > 0).cast("int")).alias("hit_rate"),
        F.sum("_pnl").alias("total_pnl"), (F.avg("ret") / (F.stddev_pop("ret") + 1e-12)).alias("sharpe"))
    dd = path_extremes(d, by, sec, order, "_pnl").select(*by, (-F.col("max_drawdown")).alias("max_drawdown"))
    if by:
        return g.join(dd, by)
    return g.withColumn("max_drawdown", dd.agg(F.max("max_drawdown")).scalar())


def two_sided_rule(df, p_hat, mip, y, sec, order, thr, ttd=None, ttd_max=None, mip_max=None, floor=0.05, stake=100.0,
                   by=None) -> DataFrame:
    """Triggers, follow triggers, wins, hit rate, profit, Sharpe and drawdown of the rule."""
    d = two_sided_trades(df, p_hat, mip, y, F.lit(thr), ttd, ttd_max, mip_max, floor)
    return _rule_summary(d, by, sec, order, stake)


def slippage_grid(df, p_hat, mip, y, sec, order, thresholds, slips, floor=0.05, stake=100.0) -> DataFrame:
    """The rule over a grid of thresholds and slippages, all cells in one pass."""
    grid = F.array(*[F.struct(F.lit(float(a)).alias("thr"), F.lit(float(b)).alias("slip")) for a in thresholds for b in slips])
    d = df.withColumn("_g", F.explode(grid)).select("*", "_g.thr", "_g.slip").drop("_g")
    d = two_sided_trades(d, p_hat, mip, y, F.col("thr"), floor=floor, slip=F.col("slip"))
    return _rule_summary(d, ["thr", "slip"], sec, order, stake)


def kelly_compound(df, p_hat, mip, y, sec, order, thr, cap=0.05, b0=10_000.0) -> DataFrame:
    """Compounded bankroll under capped Kelly stakes; the fraction does not depend on the bankroll,
    so the path is a running sum of logs. ``log_growth`` stays finite where the bankroll leaves the doubles."""
    m = clip(F.col(mip), 1e-3, 1 - 1e-3)
    edge = F.col(p_hat) - F.col(mip)
    follow = edge > thr
    p = F.when(follow, F.col(p_hat)).otherwise(1 - F.col(p_hat))
    paid = F.when(follow, m).otherwise(1 - m)
    b = 1 / paid - 1
    f = clip((b * p - (1 - p)) / b, 0, cap)
    won = F.when(follow, F.col(y)).otherwise(1 - F.col(y))
    d = df.where(follow | (edge < -thr)).withColumns({"_f": f, "_r": won / paid - 1})
    d = d.withColumn("_lg", F.log1p(F.col("_f") * F.col("_r")))
    g = d.agg(F.count(F.lit(1)).alias("triggers"), F.sum(((F.col("_f") > 0) & (F.col("_r") > 0)).cast("int")).alias("wins"))
    x = path_extremes(d, None, sec, order, "_lg").agg(F.max(F.struct("total", "lowest"))).scalar()
    return g.withColumn("_x", x).select(
        "triggers", "wins", F.col("_x.total").alias("log_growth"), (F.exp("_x.total") * b0).alias("bankroll"),
        (F.least(F.lit(1.0), F.exp("_x.lowest")) * b0).alias("min_bankroll"))


def pnl_by(df, key, cost, y, stake=100.0) -> DataFrame:
    """Trades, hit rate and profit per market."""
    d = df.withColumn("_pnl", pnl(cost, y, stake))
    return d.groupBy(*_keys(key)).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("hit_rate"), F.sum("_pnl").alias("total_pnl"))


def crowd_masks(df, side_buy, outcome_yes, price) -> DataFrame:
    """Trade on the side the market favours, against it, and favoured buys."""
    same = side_is_yes(side_buy, outcome_yes) == (F.col(price) > 0.5).cast("int")
    return df.withColumns({
        "follow_crowd": same.cast("int"), "contrarian": (~same).cast("int"),
        "buy_majority": (same & (F.col(side_buy) == 1)).cast("int")})


def signature_filter(df, p_hat, ttd, mip, prior_trades, usd, ttd_max=SIX_HOURS, mip_max=0.30, max_prior=20,
                     min_usd=1000.0) -> DataFrame:
    """Late, cheap, large trades of new wallets, with the percentile rank of their score."""
    d = pct_rank(df, p_hat, (), "p_rank")
    return d.where((F.coalesce(ttd, F.lit(0)) < ttd_max) & (F.coalesce(mip, F.lit(0.5)) < mip_max)
                   & (F.coalesce(prior_trades, F.lit(0)) < max_prior) & (F.coalesce(usd, F.lit(0.0)) > min_usd))


def sensitivity_summary(results, model, strategy, roi, setting) -> DataFrame:
    """Best and worst setting per (model, strategy) of a result grid."""
    at = F.struct(F.col(roi), F.col(setting))
    return results.groupBy(model, strategy).agg(
        F.max(roi).alias("best_roi"), F.max_by(setting, at).alias("best_setting"), F.min(roi).alias("worst_roi"),
        F.min_by(setting, at).alias("worst_setting"), F.avg(roi).alias("mean_roi"))


def position_pnl(df, key, t, pos, ret, cost=0.001) -> DataFrame:
    """long/cash returns less a cost per switch (the start counts as invested), and their growth."""
    w = Window.partitionBy(*_keys(key)).orderBy(t)
    switch = F.abs(F.col(pos) - F.lag(pos, 1, 1).over(w))
    d = df.withColumns({"switched": switch, "net": F.col(pos) * F.coalesce(ret, F.lit(0.0)) - switch * cost})
    return cum_return(d, key, t, "net", "growth")


def weight_grid(df, t, ret_a, ret_b, n=21, periods=252) -> DataFrame:
    """Terminal return, annual volatility, Sharpe, daily VaR and drawdown per portfolio weight."""
    ws = F.array(*[F.lit(round(i / (n - 1), 4)) for i in range(n)])
    d = df.withColumn("weight", F.explode(ws))
    d = d.withColumn("ret", F.col("weight") * F.coalesce(ret_a, F.lit(0.0)) + (1 - F.col("weight")) * F.coalesce(ret_b, F.lit(0.0)))
    d = cum_return(d, "weight", t, "ret", "growth").withColumn("_v", F.col("growth") + 1)
    d = drawdown(d, "weight", t, "_v")
    g = d.groupBy("weight").agg(
        F.max_by("growth", t).alias("terminal"), (F.stddev_samp("ret") * math.sqrt(periods)).alias("ann_vol"),
        (F.avg("ret") * periods).alias("_ann"), F.min("drawdown").alias("max_drawdown"),
        (-F.percentile("ret", 0.05)).alias("var_95"))  # one value per day
    return g.withColumn("sharpe", F.when(F.col("ann_vol") > 0, F.col("_ann") / F.col("ann_vol"))).drop("_ann")


def risk_summary(df, ret, periods=252, by=None) -> DataFrame:
    """Annualised return, volatility and Sharpe, bias-corrected skewness and excess kurtosis."""
    n, g1, g2 = F.count(ret), F.skewness(ret), F.kurtosis(ret)
    vol = F.stddev_samp(ret) * math.sqrt(periods)
    return df.groupBy(*_keys(by)).agg(
        (F.avg(ret) * periods).alias("ann_return"), vol.alias("ann_vol"),
        F.when(vol > 0, F.avg(ret) * periods / vol).alias("sharpe"),
        F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
        F.when(n > 3, ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3))).alias("kurt"))


def var_cvar(df, ret, levels=(0.95, 0.99), by=None) -> DataFrame:
    """Historical VaR and the mean loss at or beyond it, exact quantiles."""
    by = _keys(by)
    names = [f"v{i}" for i in range(len(levels))]
    q = quantiles(df, ret, [1 - x for x in levels], by, names)
    d = df.join(q, by) if by else df.withColumns(
        {n: quantiles(df, ret, [1 - x], names=[n]).agg(F.max(n)).scalar() for n, x in zip(names, levels)})
    out = []
    for n, x in zip(names, levels):
        tag = round(x * 100)
        out += [(-F.max(n)).alias(f"var_{tag}"), (-F.avg(F.when(F.col(ret) <= F.col(n), F.col(ret)))).alias(f"cvar_{tag}")]
    return d.groupBy(*by).agg(*out)


def horizon_stats(df, key, t, price, horizons=(7, 14, 30)) -> DataFrame:
    """Mean, median, share positive, min and max of forward returns per horizon."""
    keys = _keys(key)
    w = Window.partitionBy(*keys).orderBy(t)
    d = df.withColumns({f"_f{h}": F.lead(price, h).over(w) / F.col(price) - 1 for h in horizons})
    fw = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_f{h}").alias("roi")) for h in horizons])
    d = d.select(*keys, F.explode(fw).alias("f")).select(*keys, "f.*").where("roi IS NOT NULL")
    return d.groupBy(*keys, "horizon").agg(
        F.avg("roi").alias("mean"), F.median("roi").alias("median"), F.avg((F.col("roi") > 0).cast("int")).alias("p_positive"),
        F.min("roi").alias("min"), F.max("roi").alias("max"))


def project_linear(df, key, t, v, window, until) -> DataFrame:
    """Linear path from the last period with the mean recent step and a 1.96*sd*sqrt(h) band."""
    keys = _keys(key)
    w = Window.partitionBy(*keys).orderBy(t)
    d = df.withColumn("_d", F.col(v) - F.lag(v).over(w)).withColumn("_last", F.max(t).over(Window.partitionBy(*keys)))
    g = d.groupBy(*keys).agg(
        F.max(t).alias("_t0"), F.max_by(v, t).alias("_v0"), F.stddev_samp("_d").alias("_sd"),
        F.avg(F.when(F.col(t) > F.col("_last") - window + 1, F.col("_d"))).alias("_step"))
    p = g.withColumn(t, F.explode(F.sequence(F.col("_t0"), F.lit(until))))
    h = F.col(t) - F.col("_t0")
    mid, half = F.col("_v0") + F.col("_step") * h, 1.96 * F.col("_sd") * F.sqrt(h.cast("double"))
    return p.select(*keys, t, mid.alias("projected"), (mid - half).alias("lower"), (mid + half).alias("upper"))
