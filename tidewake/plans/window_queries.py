"""W queries on events-as-trades and on order timelines."""

from pyspark.sql import functions as F

from ..operators import windows as w
from ..operators.timeline import prior, rolling
from .registry import query
from .trades import TRADES_SQL, r, trades

P = "ORDER BY ts, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def rng(secs, key="market"):
    return f"(PARTITION BY {key} ORDER BY sec RANGE BETWEEN {secs} PRECEDING AND 1 PRECEDING)"


def pre(key="taker"):
    return f"(PARTITION BY {key} {P})"


def one(key="taker"):
    return f"(PARTITION BY {key} ORDER BY ts, trade_id)"


def sql(body):
    return f"WITH {TRADES_SQL} {body}"


@query("W00_causal_features", sql(f"""
, f AS (SELECT market, usd, price, count(*) OVER {pre()} AS pc, coalesce(sum(usd) OVER {pre()}, 0) AS ps,
  coalesce(lag(price) OVER {one()}, 0.5) AS pp, coalesce(sec - lag(sec) OVER {one()}, 0) AS gap,
  coalesce(sum(usd) OVER {rng(3600, 'taker')}, 0) AS v1, count(*) OVER {rng(86400, 'taker')} AS n24 FROM t)
SELECT market, count(*) AS n, round(avg(pc), 6) AS avg_prior_count, round(avg(ps), 4) AS avg_prior_sum,
  round(avg(pp), 6) AS avg_pre_price, round(avg(ln(1 + gap)), 6) AS avg_log_gap,
  round(avg(v1), 6) AS avg_vol_1h, round(avg(n24), 6) AS avg_n_24h FROM f GROUP BY market"""))
def _(t):
    """Flagship: causal features per taker, summarised per market."""
    d = trades(t)
    d = prior(d, "taker", "sec", ("ts", "trade_id"), {
        "pc": ("count", F.lit(1)), "ps": ("sum", F.col("usd")), "pp": ("lag", F.col("price")),
        "prev": ("lag", F.col("sec"))})
    d = rolling(d, "taker", "sec", {"v1": (3600, "sum", F.col("usd")), "n24": (86400, "count", F.lit(1))})
    return d.groupBy("market").agg(
        F.count("*").alias("n"), F.round(F.avg("pc"), 6).alias("avg_prior_count"),
        F.round(F.avg("ps"), 4).alias("avg_prior_sum"),
        F.round(F.avg(F.coalesce("pp", F.lit(0.5))), 6).alias("avg_pre_price"),
        F.round(F.avg(F.log1p(F.coalesce(F.col("sec") - F.col("prev"), F.lit(0)))), 6).alias("avg_log_gap"),
        F.round(F.avg("v1"), 6).alias("avg_vol_1h"), F.round(F.avg("n24"), 6).alias("avg_n_24h"))


@query("W01_prior_count", sql(f"""SELECT trade_id, count(*) OVER {pre()} AS prior_count,
  round(ln(1 + count(*) OVER {pre()}), 6) AS log_prior_count FROM t"""))
def _(t):
    return r(w.prior_count(trades(t), "taker"), "log_prior_count").select("trade_id", "prior_count", "log_prior_count")


@query("W02_prior_sum", sql(f"SELECT trade_id, round(coalesce(sum(usd) OVER {pre()}, 0), 4) AS prior_sum FROM t"))
def _(t):
    return r(w.prior_sum(trades(t), "taker", "usd"), "prior_sum", digits=4).select("trade_id", "prior_sum")


@query("W03_prior_share", sql(f"""SELECT trade_id, round(sum(CASE WHEN side_buy = 1 THEN usd ELSE 0 END) OVER {pre()}
  / nullif(sum(usd) OVER {pre()}, 0), 6) AS prior_share FROM t"""))
def _(t):
    d = w.prior_share(trades(t), "taker", "usd", F.col("side_buy") == 1)
    return r(d, "prior_share").select("trade_id", "prior_share")


@query("W04_rolling_sum", sql(f"""SELECT trade_id, round(coalesce(sum(usd) OVER {rng(300)}, 0), 4) AS vol_5m,
  round(coalesce(sum(usd) OVER {rng(3600)}, 0), 4) AS vol_1h, round(coalesce(sum(usd) OVER {rng(86400)}, 0), 4) AS vol_24h,
  round(ln(1 + coalesce(sum(usd) OVER {rng(3600)}, 0)), 6) AS log_vol_1h FROM t"""))
def _(t):
    d = w.rolling_sum(trades(t), "market", "usd")
    d = r(r(d, "vol_5m", "vol_1h", "vol_24h", digits=4), "log_vol_1h")
    return d.select("trade_id", "vol_5m", "vol_1h", "vol_24h", "log_vol_1h")


@query("W05_rolling_count", sql(f"""SELECT trade_id, count(*) OVER {rng(300)} AS n_5m, count(*) OVER {rng(3600)} AS n_1h,
  count(*) OVER {rng(86400)} AS n_24h FROM t"""))
def _(t):
    return w.rolling_count(trades(t), "market").select("trade_id", "n_5m", "n_1h", "n_24h")


@query("W06_order_flow_imbalance", sql(f"""SELECT trade_id, round(coalesce(
  sum(CASE WHEN side_buy = 1 THEN usd ELSE -usd END) OVER {rng(3600)} / nullif(sum(usd) OVER {rng(3600)}, 0), 0), 6)
  AS imbalance FROM t"""))
def _(t):
    return r(w.order_flow_imbalance(trades(t), "market", "usd", "side_buy"), "imbalance").select("trade_id", "imbalance")


@query("W07_rolling_std", sql(f"SELECT trade_id, round(stddev_samp(price) OVER {rng(3600)}, 5) AS std FROM t"))
def _(t):
    return r(w.rolling_std(trades(t), "market", "price"), "std", digits=5).select("trade_id", "std")


@query("W08_rolling_price_stats", sql(f"""SELECT trade_id, round(avg(price) OVER {rng(3600)}, 6) AS w_mean,
  max(price) OVER {rng(3600)} AS w_max, min(price) OVER {rng(3600)} AS w_min,
  round(max(price) OVER {rng(3600)} - min(price) OVER {rng(3600)}, 6) AS w_range,
  round(price - avg(price) OVER {rng(3600)}, 6) AS vs_mean FROM t"""))
def _(t):
    d = r(w.rolling_price_stats(trades(t), "market", "price"), "w_mean", "w_range", "vs_mean")
    return d.select("trade_id", "w_mean", "w_max", "w_min", "w_range", "vs_mean")


@query("W09_size_vs_recent", sql(f"""SELECT trade_id,
  round(least(coalesce(usd / nullif(sum(usd) OVER {rng(3600)}, 0), 0), 100), 6) AS size_vs_volume,
  round(least(coalesce(usd / nullif(avg(usd) OVER {rng(3600)}, 0), 0), 100), 6) AS size_vs_avg FROM t"""))
def _(t):
    d = r(w.size_vs_recent(trades(t), "market", "usd"), "size_vs_volume", "size_vs_avg")
    return d.select("trade_id", "size_vs_volume", "size_vs_avg")


@query("W10_pre_trade_price", sql(f"SELECT trade_id, coalesce(lag(price) OVER {one('market')}, 0.5) AS pre_price FROM t"))
def _(t):
    return w.pre_trade_price(trades(t), "market").select("trade_id", "pre_price")


@query("W11_gap_features", sql(f"""SELECT trade_id, gap, round(ln(1 + gap), 6) AS log_gap,
  CAST(gap > 3600 AS INTEGER) AS quiet FROM (SELECT *, coalesce(sec - lag(sec) OVER {one('market')}, 0) AS gap FROM t)"""))
def _(t):
    return r(w.gap_features(trades(t), "market"), "log_gap").select("trade_id", "gap", "log_gap", "quiet")


@query("W12_rolling_share", sql(f"""SELECT trade_id, round(s, 6) AS share, round(s - 0.5, 6) AS share_skew FROM (
  SELECT trade_id, coalesce(sum(CASE WHEN outcome_yes = 1 THEN usd ELSE 0 END) OVER {rng(3600)}
  / nullif(sum(usd) OVER {rng(3600)}, 0), 0.5) AS s FROM t)"""))
def _(t):
    d = w.rolling_share(trades(t), "market", "usd", F.col("outcome_yes") == 1)
    return r(d, "share", "share_skew").select("trade_id", "share", "share_skew")


@query("W13_realized_var", sql(f"""SELECT trade_id, round(coalesce(sum(d * d) OVER {rng(3600)}, 0), 6) AS realized_var
  FROM (SELECT *, price - lag(price) OVER {one('market')} AS d FROM t)"""))
def _(t):
    return r(w.realized_var(trades(t), "market", "price"), "realized_var").select("trade_id", "realized_var")


@query("W14_jump_component", sql(f"""SELECT trade_id, round(greatest(coalesce(sum(d * d) OVER {rng(3600)}, 0)
  - pi() / 2 * coalesce(sum(abs(d) * abs(d1)) OVER {rng(3600)}, 0), 0), 6) AS jump
  FROM (SELECT *, lag(d) OVER {one('market')} AS d1 FROM (SELECT *, price - lag(price) OVER {one('market')} AS d FROM t))"""))
def _(t):
    return r(w.jump_component(trades(t), "market", "price"), "jump").select("trade_id", "jump")


@query("W15_flow_autocorr", sql(f"""SELECT trade_id, round(coalesce(avg(x * x1) OVER {rng(3600)}, 0), 8) AS flow_autocorr
  FROM (SELECT *, lag(x) OVER {one('market')} AS x1 FROM (SELECT *, CASE WHEN side_buy = 1 THEN usd ELSE -usd END AS x FROM t))"""))
def _(t):
    signed = F.when(F.col("side_buy") == 1, F.col("usd")).otherwise(-F.col("usd"))
    d = w.flow_autocorr(trades(t), "market", signed)
    return r(d, "flow_autocorr", digits=8).select("trade_id", "flow_autocorr")


@query("W16_prior_distinct", sql(f"""SELECT trade_id, f AS first_seen,
  CAST(coalesce(sum(f) OVER {pre()}, 0) AS BIGINT) AS prior_distinct FROM (SELECT *,
  CAST(row_number() OVER {one('taker, market')} = 1 AS INTEGER) AS f FROM t)"""))
def _(t):
    return w.prior_distinct(trades(t), "taker", "market").select("trade_id", "first_seen", "prior_distinct")


@query("W17_prior_position", sql(f"""SELECT trade_id, round(p, 4) AS position, round(tanh(p / 1000), 6) AS position_bounded
  FROM (SELECT *, coalesce(sum(CASE WHEN side_buy = 1 THEN usd ELSE -usd END) OVER {pre('taker, market')}, 0) AS p FROM t)"""))
def _(t):
    signed = F.when(F.col("side_buy") == 1, F.col("usd")).otherwise(-F.col("usd"))
    d = w.prior_position(trades(t), ["taker", "market"], signed)
    return r(r(d, "position", digits=4), "position_bounded").select("trade_id", "position", "position_bounded")


@query("W18_purity_same_code", sql(f"""SELECT trade_id, round(count(*) OVER {pre('taker, side_buy')}
  / nullif(CAST(count(*) OVER {pre()} AS DOUBLE), 0), 6) AS purity FROM t"""))
def _(t):
    return r(w.purity_same_code(trades(t), "taker", "side_buy"), "purity").select("trade_id", "purity")


@query("W19_two_side_mix", sql(f"""SELECT trade_id, CASE WHEN n0 + n1 > 0 THEN round((n0 * n0 + n1 * n1)
  / CAST((n0 + n1) * (n0 + n1) AS DOUBLE), 6) END AS mix_purity, CAST(n0 > 0 AND n1 > 0 AS INTEGER) AS both_sides,
  CASE WHEN n0 + n1 > 0 THEN round(least(n0, n1) / CAST(greatest(n0, n1) AS DOUBLE), 6) END AS spread_ratio
  FROM (SELECT trade_id, count(*) FILTER (outcome_yes = 0) OVER {pre('taker, market')} AS n0,
  count(*) FILTER (outcome_yes = 1) OVER {pre('taker, market')} AS n1 FROM t)"""))
def _(t):
    d = r(w.two_side_mix(trades(t), ["taker", "market"], "outcome_yes"), "mix_purity", "spread_ratio")
    return d.select("trade_id", "mix_purity", "both_sides", "spread_ratio")


@query("W20_prior_median_gap", sql(f"""SELECT trade_id, median(gap) OVER {pre()} AS prior_median_gap FROM (
  SELECT *, sec - lag(sec) OVER {one()} AS gap FROM t)"""))
def _(t):
    return w.prior_median_gap(trades(t), "taker").select("trade_id", "prior_median_gap")


@query("W21_whale_flag", sql("""
, n AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY ts, trade_id) AS i, CAST(round(usd / 0.01) AS BIGINT) AS c FROM t)
, v AS (SELECT a.trade_id, b.taker, CAST(sum(b.c) AS BIGINT) AS vol FROM n a JOIN n b ON a.market = b.market AND b.i < a.i GROUP BY ALL)
, q AS (SELECT trade_id, count(*) AS wallets, quantile_cont(vol, 0.95) AS tau FROM v GROUP BY trade_id)
SELECT n.trade_id, CAST(coalesce(q.wallets >= 20 AND coalesce(v.vol, 0) >= q.tau, false) AS INTEGER) AS whale
FROM n LEFT JOIN q USING (trade_id) LEFT JOIN v ON v.trade_id = n.trade_id AND v.taker = n.taker"""))
def _(t):
    return w.whale_flag(trades(t), "market", "taker", "usd").select("trade_id", "whale")


RES = "CASE WHEN k % 7 <> 0 THEN sec + k * 3600 END"


@query("W22_causal_win_rate", sql(f"""
, a AS (SELECT *, {RES} AS res FROM t)
SELECT a.trade_id, round(avg(b.outcome_yes), 6) AS win_rate, CAST(count(b.res) > 0 AS INTEGER) AS has_resolved
FROM a LEFT JOIN a b ON a.taker = b.taker AND b.res < a.sec GROUP BY a.trade_id"""))
def _(t):
    d = trades(t).withColumn("res", F.when(F.col("k") % 7 != 0, F.col("sec") + F.col("k") * 3600))
    return r(w.causal_win_rate(d, "taker", "outcome_yes", "res"), "win_rate").select(
        "trade_id", "win_rate", "has_resolved")


@query("W23_win_rate_leak_gap", sql(f"""
, a AS (SELECT *, {RES} AS res, avg(outcome_yes) OVER {pre()} AS leaky FROM t)
, b AS (SELECT a.trade_id, any_value(a.outcome_yes) AS y, any_value(a.leaky) AS leaky, avg(b.outcome_yes) AS causal
  FROM a LEFT JOIN a b ON a.taker = b.taker AND b.res < a.sec GROUP BY a.trade_id)
SELECT round(corr(leaky, y), 6) AS corr_leaky, round(corr(causal, y), 6) AS corr_causal,
  round(corr(leaky, y) - corr(causal, y), 6) AS leak_gap FROM b"""))
def _(t):
    d = trades(t).withColumn("res", F.when(F.col("k") % 7 != 0, F.col("sec") + F.col("k") * 3600))
    return r(w.win_rate_leak_gap(d, "taker", "outcome_yes", "res"), "corr_leaky", "corr_causal", "leak_gap")


LABELS = ["click", "error", "purchase", "signup", "view"]


@query("W24_expanding_entropy", sql(f"""
, f AS (SELECT *, row_number() OVER {one('taker, k')} = 1 AS fs FROM t)
, c AS (SELECT trade_id, {', '.join(f"count(*) FILTER (fs AND market = '{m}') OVER {pre()} AS n{i}" for i, m in enumerate(LABELS))} FROM f)
, s AS (SELECT *, n0 + n1 + n2 + n3 + n4 AS n FROM c)
SELECT trade_id, CASE WHEN n >= 2 THEN round({' + '.join(f"CASE WHEN n{i} > 0 THEN -(n{i} / CAST(n AS DOUBLE)) * ln(n{i} / CAST(n AS DOUBLE)) ELSE 0 END" for i in range(5))}, 6) END AS entropy FROM s"""))
def _(t):
    return r(w.expanding_entropy(trades(t), "taker", "k", "market", LABELS), "entropy").select("trade_id", "entropy")


@query("W25_burst", sql(f"""SELECT trade_id, count(*) OVER {rng(300)} AS burst_n,
  CAST(count(*) OVER {rng(600)} >= 3 AS INTEGER) AS burst_flag FROM t"""))
def _(t):
    return w.burst(trades(t), "market").select("trade_id", "burst_n", "burst_flag")


@query("W26_since_first", sql("""SELECT trade_id, sec - min(sec) OVER (PARTITION BY taker) AS since_first,
  min(sec) OVER (PARTITION BY taker) - sec AS first_seen_offset FROM t"""))
def _(t):
    return w.since_first(trades(t), "taker").select("trade_id", "since_first", "first_seen_offset")


@query("W27_size_vs_prior", sql(f"""SELECT trade_id, round(usd / nullif(avg(usd) OVER {pre()}, 0), 6) AS size_vs_own_avg,
  round(usd / nullif(sum(usd) OVER {pre('market')}, 0), 6) AS size_vs_market_volume,
  round(usd / nullif(avg(usd) OVER {pre('market')}, 0), 6) AS size_vs_market_avg FROM t"""))
def _(t):
    d = w.size_vs_prior(trades(t), "taker", "market", "usd")
    c = ["size_vs_own_avg", "size_vs_market_volume", "size_vs_market_avg"]
    return r(d, *c).select("trade_id", *c)


@query("W28_pct_elapsed", sql("""SELECT trade_id, CASE WHEN dl - t0 > 0 THEN
  round(least(greatest((sec - t0) / CAST(dl - t0 AS DOUBLE), 0), 1), 6) END AS pct_elapsed
  FROM (SELECT *, min(sec) OVER (PARTITION BY taker) AS t0, CAST(1704067200 + k * 86400 AS BIGINT) AS dl FROM t)"""))
def _(t):
    d = trades(t).withColumn("dl", (F.lit(1704067200) + F.col("k") * 86400).cast("bigint"))
    return r(w.pct_elapsed(d, "taker", "dl"), "pct_elapsed").select("trade_id", "pct_elapsed")


@query("W29_exit_flip", sql(f"""SELECT trade_id, CAST(side_buy = 0 AND p > 0 AND usd >= 0.9 * p AS INTEGER) AS is_exit,
  CAST(p <> 0 AND sign(p) * sign(p + CASE WHEN side_buy = 1 THEN usd ELSE -usd END) < 0 AS INTEGER) AS is_flip
  FROM (SELECT *, coalesce(sum(CASE WHEN side_buy = 1 THEN usd ELSE -usd END) OVER {pre('taker, market')}, 0) AS p FROM t)"""))
def _(t):
    return w.exit_flip(trades(t), ["taker", "market"], "usd", "side_buy").select("trade_id", "is_exit", "is_flip")


@query("W30_pre_yes_price", sql(f"""SELECT trade_id, round(coalesce(
  last_value(CASE WHEN outcome_yes = 1 THEN price END IGNORE NULLS) OVER {pre('market')},
  1 - last_value(CASE WHEN outcome_yes = 0 THEN price END IGNORE NULLS) OVER {pre('market')}, 0.5), 6) AS pre_yes FROM t"""))
def _(t):
    return r(w.pre_yes_price(trades(t), "market", "price", "outcome_yes"), "pre_yes").select("trade_id", "pre_yes")


@query("W31_sell_semantics", sql(f"""SELECT side_buy, count(*) AS n, CAST(sum(b) AS BIGINT) AS prior_buys,
  round(avg(CASE WHEN side_buy = 0 AND b > 0 THEN 1 ELSE 0 END), 6) AS closing_share
  FROM (SELECT *, count(*) FILTER (side_buy = 1) OVER {pre('taker, market')} AS b FROM t) GROUP BY side_buy"""))
def _(t):
    d = w.sell_semantics(trades(t), ["taker", "market"], "side_buy")
    return d.groupBy("side_buy").agg(F.count("*").alias("n"), F.sum("prior_buys").alias("prior_buys"),
                                     F.round(F.avg("closing_sell"), 6).alias("closing_share"))


@query("W32_block_features", sql("""SELECT trade_id, count(*) OVER (PARTITION BY market, sec // 600) AS block_trades,
  row_number() OVER (PARTITION BY market, sec // 600 ORDER BY ts, trade_id) AS block_position FROM t"""))
def _(t):
    d = trades(t).withColumn("block", F.floor(F.col("sec") / 600))
    return w.block_features(d, ["market", "block"]).select("trade_id", "block_trades", "block_position")


@query("W33_residualise_prior_mean", sql(f"""SELECT trade_id, round(coalesce(usd - avg(usd) OVER {pre()}, 0), 8) AS residual FROM t"""))
def _(t):
    return r(w.residualise_prior_mean(trades(t), "taker", "usd"), "residual", digits=8).select("trade_id", "residual")


DAILY_SQL = """d AS (SELECT event_type AS k, CAST(ts AS DATE) AS day, sum(value) AS v, count(*) AS n FROM events GROUP BY ALL)"""


def daily(t):
    return t.events.groupBy(F.col("event_type").alias("k"), F.to_date("ts").alias("day")).agg(
        F.sum("value").alias("v"), F.count("*").alias("n"))


S = "(PARTITION BY k ORDER BY day)"
RET_SQL = f"{DAILY_SQL}, r AS (SELECT *, v / lag(v) OVER {S} - 1 AS ret FROM d)"


@query("W34_rolling_rows", f"""WITH {DAILY_SQL} SELECT k, day,
  CASE WHEN count(v) OVER w >= 7 THEN round(avg(v) OVER w, 4) END AS avg_7,
  CASE WHEN count(v) OVER w >= 7 THEN round(stddev_samp(v) OVER w, 4) END AS std_7 FROM d
  WINDOW w AS (PARTITION BY k ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def _(t):
    d = w.rolling_rows(w.rolling_rows(daily(t), "k", "day", "v", 7), "k", "day", "v", 7, "std")
    return r(d, "avg_7", "std_7", digits=4).select("k", "day", "avg_7", "std_7")


@query("W35_lags_leads", f"""WITH {DAILY_SQL} SELECT k, day, {', '.join(f'round(lag(v, {n}) OVER {S}, 4) AS lag_{n}' for n in (1, 3, 5, 7))},
  {', '.join(f'round(lead(v, {h}) OVER {S} / v - 1, 6) AS fwd_{h}' for h in (1, 7))},
  CAST(lead(v, 1) OVER {S} > v AS INTEGER) AS up_next FROM d""")
def _(t):
    d = w.lags_leads(daily(t), "k", "day", "v").drop("v", "n")
    return r(r(d, "lag_1", "lag_3", "lag_5", "lag_7", digits=4), "fwd_1", "fwd_7")


@query("W36_returns", f"""WITH {DAILY_SQL} SELECT k, day, round(v / lag(v) OVER {S} - 1, 6) AS ret,
  round(ln(v) - ln(lag(v) OVER {S}), 6) AS log_ret, round(v - lag(v) OVER {S}, 4) AS diff FROM d""")
def _(t):
    return r(r(w.returns(daily(t), "k", "day", "v"), "ret", "log_ret"), "diff", digits=4).drop("v", "n")


@query("W37_cum_return", f"""WITH {RET_SQL} SELECT k, day, round(exp(sum(ln(1 + ret)) OVER {S}) - 1, 6) AS cum_return FROM r""")
def _(t):
    d = w.cum_return(w.returns(daily(t), "k", "day", "v"), "k", "day", "ret")
    return r(d, "cum_return").select("k", "day", "cum_return")


@query("W38_drawdown", f"""WITH {DAILY_SQL}, p AS (SELECT *, max(v) OVER {S} AS peak FROM d)
  SELECT k, day, round(v / peak - 1, 6) AS drawdown, round(min(v / peak - 1) OVER {S}, 6) AS max_drawdown FROM p""")
def _(t):
    d = w.drawdown(daily(t), "k", "day", "v")
    return r(d, "drawdown", "max_drawdown").select("k", "day", "drawdown", "max_drawdown")


@query("W39_rolling_roi", f"""WITH {RET_SQL} SELECT k, day, CASE WHEN count(ret) OVER w = 7 THEN
  round(exp(sum(ln(1 + ret)) OVER w) - 1, 6) END AS rolling_roi FROM r
  WINDOW w AS (PARTITION BY k ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def _(t):
    d = w.rolling_roi(w.returns(daily(t), "k", "day", "v"), "k", "day", "ret", 7)
    return r(d, "rolling_roi").select("k", "day", "rolling_roi")


@query("W40_reindex_ffill", """WITH d AS (SELECT user_id AS k, CAST(ts AS DATE) AS day, max(value) AS v FROM events GROUP BY ALL),
  s AS (SELECT k, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY k)
  SELECT s.k, s.day, last_value(d.v IGNORE NULLS) OVER (PARTITION BY s.k ORDER BY s.day ROWS UNBOUNDED PRECEDING) AS v
  FROM s LEFT JOIN d ON s.k = d.k AND s.day = d.day""")
def _(t):
    d = t.events.groupBy(F.col("user_id").alias("k"), F.to_date("ts").alias("day")).agg(F.max("value").alias("v"))
    return w.reindex_ffill(d, "k", "day", ["v"])


@query("W41_daily_drift", """WITH d AS (SELECT event_type AS k, CAST(ts AS DATE) AS day, avg(value) AS mean, count(value) AS n
  FROM events GROUP BY ALL HAVING count(value) >= 60)
  SELECT k, day, round(mean, 6) AS mean, n, CASE WHEN count(mean) OVER w >= 2 THEN round(avg(mean) OVER w, 6) END AS drift
  FROM d WINDOW w AS (PARTITION BY k ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def _(t):
    return r(w.daily_drift(t.events.withColumnRenamed("event_type", "k"), "k", "ts", "value", 60), "mean", "drift")


@query("W42_temporal_fold", sql("""SELECT trade_id, round(p, 6) AS position, CASE WHEN p < 0.6 THEN 'train' WHEN p < 0.8 THEN 'val'
  ELSE 'test' END AS fold FROM (SELECT trade_id, (row_number() OVER (PARTITION BY market ORDER BY ts, trade_id) - 1)
  / CAST(count(*) OVER (PARTITION BY market) AS DOUBLE) AS p FROM t)"""))
def _(t):
    return r(w.temporal_fold(trades(t), "market"), "position").select("trade_id", "position", "fold")


@query("W43_pct_rank", """SELECT event_id, round((rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0)
  / count(*) OVER (), 6) AS pct_rank FROM events""")
def _(t):
    return r(w.pct_rank(t.events, "value"), "pct_rank").select("event_id", "pct_rank")


@query("W44_qcut", """WITH e AS (SELECT list_distinct(quantile_cont(value, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1])) AS e FROM events)
  SELECT bucket, count(*) AS n FROM (SELECT CAST((SELECT count(*) FROM (SELECT unnest(e.e) AS x) WHERE x < value AND x > (SELECT min(value) FROM events)) AS BIGINT)
  AS bucket FROM events, e) GROUP BY bucket""")
def _(t):
    return w.qcut(t.events, "value", 10).groupBy("bucket").agg(F.count("*").alias("n"))


@query("W45_lock_time", sql("""SELECT taker, min(sec) AS lock_sec FROM (SELECT *, median(price) OVER (PARTITION BY taker ORDER BY ts, trade_id
  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m FROM t) WHERE price >= 0.9 AND m >= 0.55 GROUP BY taker"""))
def _(t):
    return w.lock_time(trades(t), "taker", "price", lock=0.9, floor=0.55)
