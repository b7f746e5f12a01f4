"""B, Y and Q queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import quality as q, series as y, strategy as b, windows as w
from .registry import query
from .stat_queries import PR, PRED_SQL, T, U, preds
from .trades import T_SQL, TRADES_SQL, r, trades

BT_SQL = f"""{PRED_SQL}, bt AS (SELECT *, p - c AS edge FROM (SELECT *, id * 7919 % 100000 AS ttd, least(greatest(pm, 0.05), 0.95) AS c FROM pr))"""


def bets(t):
    d = preds(t).withColumns({"ttd": F.col("id") * 7919 % 100000, "c": s.clip("pm", 0.05, 0.95)})
    return d.withColumn("edge", F.col("p") - F.col("c"))


def BT(body):
    return f"WITH {BT_SQL}{body}"


def top(score, pct, name):
    return f"SELECT '{name}' AS strategy, * FROM (SELECT * FROM bt QUALIFY row_number() OVER (ORDER BY {score} DESC, id) <= greatest(1, floor(count(*) OVER () * {pct})))"


SIG = f""", sg AS (SELECT 'phat_gt_0.99' AS strategy, * FROM bt WHERE p >= 0.99 UNION ALL SELECT 'phat_gt_0.95', * FROM bt WHERE p >= 0.95 UNION ALL SELECT 'phat_gt_0.9', * FROM bt WHERE p >= 0.9
  UNION ALL SELECT 'general_ev', * FROM bt WHERE edge > 0.02 UNION ALL SELECT 'general_ev_late', * FROM bt WHERE edge > 0.02 AND ttd < 21600
  UNION ALL SELECT 'general_ev_cheap', * FROM bt WHERE edge > 0.02 AND c < 0.3 UNION ALL SELECT 'home_run', * FROM bt WHERE edge > 0.2 AND c < 0.3 AND ttd < 21600
  UNION ALL {top('p', 0.01, 'top1pct_phat')} UNION ALL {top('edge', 0.01, 'top1pct_edge')} UNION ALL {top('edge', 0.05, 'top5pct_edge')})"""


def signals(t):
    # rounded so both engines see the same ties at the cut
    return b.strategy_signals(bets(t).withColumn("edge", F.round("edge", 6)), "id", "p", "edge", "c", "ttd")


SIGR = SIG.replace("FROM bt", "FROM btr").replace(", sg AS", ", btr AS (SELECT * REPLACE (round(edge, 6) AS edge) FROM bt), sg AS")


@query("B01_strategy_signals", BT(f"{SIGR} SELECT strategy, id FROM sg"))
def _(t):
    return signals(t).select("strategy", "id")


PNL = "CASE WHEN y = 1 THEN 100 * (1 - c) / c ELSE -100.0 END"


def dd_sql(src, by, step):
    part = f"PARTITION BY {by}" if by else ""
    return f"""(SELECT {by + ',' if by else ''} max(pk - cu) AS dd, min(cu) AS lo FROM (SELECT *, max(cu) OVER ({part} ORDER BY sec, id) AS pk FROM (SELECT *, sum({step}) OVER ({part} ORDER BY sec, id) AS cu FROM {src})) {'GROUP BY ' + by if by else ''})"""


@query("B02_flat_stake", BT(f"""{SIGR}, pl AS (SELECT *, {PNL} AS pnl FROM sg)
  SELECT strategy, n_trades, hit_rate, total_pnl, mean_pnl, sharpe, n_markets, round(dd, 3) AS max_drawdown FROM (SELECT strategy, count(*) AS n_trades, round(avg(y), 6) AS hit_rate, round(sum(pnl), 3) AS total_pnl, round(avg(pnl), 4) AS mean_pnl,
  CASE WHEN stddev_pop(pnl) > 0 THEN round(avg(pnl) / stddev_pop(pnl), 6) END AS sharpe, count(DISTINCT market) AS n_markets FROM pl GROUP BY 1) JOIN {dd_sql('pl', 'strategy', 'pnl')} USING (strategy)"""))
def _(t):
    d = b.flat_stake(signals(t), "c", "y", "market", "sec", ["sec", "id"])
    return r(r(r(d, "total_pnl", "max_drawdown", digits=3), "mean_pnl", digits=4), "hit_rate", "sharpe")


def rule_sql(src, by, thr, slip=None, gates="", floor=True):
    paid = "CASE WHEN p - pm > {0} THEN pm ELSE 1 - pm END".format(thr)
    if floor:
        paid = f"least(greatest({paid}, 0.05), 0.95)"
    if slip:
        paid = f"least({paid} + {slip}, 0.999)"
    return f"""tr AS (SELECT *, (p - pm > {thr})::INTEGER AS follow, CASE WHEN p - pm > {thr} THEN y ELSE 1 - y END / ({paid}) - 1 AS ret FROM {src} WHERE abs(p - pm) > {thr} {gates})"""


RULE_COLS = "count(*) AS triggers, sum(follow)::BIGINT AS follows, sum((ret > 0)::INTEGER)::BIGINT AS wins, round(avg((ret > 0)::INTEGER), 6) AS hit_rate, round(sum(ret * 100), 3) AS total_pnl, round(avg(ret) / (stddev_pop(ret) + 1e-12), 6) AS sharpe"


@query("B03_two_sided_rule", BT(f""", {rule_sql('bt', None, '0.1', gates='AND ttd < 50000 AND pm < 0.6')}
  SELECT {RULE_COLS}, round(-(SELECT dd FROM {dd_sql('tr', '', 'ret * 100')}), 3) AS max_drawdown FROM tr"""))
def _(t):
    d = b.two_sided_rule(bets(t), "p", "pm", "y", "sec", ["sec", "id"], 0.1, "ttd", 50000, 0.6)
    return r(r(d, "total_pnl", "max_drawdown", digits=3), "hit_rate", "sharpe")


@query("B04_slippage_grid", BT(f""", gr AS (SELECT * FROM bt, (SELECT unnest([0.1::DOUBLE, 0.2]) AS thr), (SELECT unnest([0::DOUBLE, 0.01, 0.03]) AS slip)), {rule_sql('gr', None, 'thr', 'slip')}
  SELECT thr, slip, triggers, follows, wins, hit_rate, total_pnl, sharpe, round(-dd, 3) AS max_drawdown FROM (SELECT thr, slip, {RULE_COLS} FROM tr GROUP BY ALL) JOIN {dd_sql('tr', 'thr, slip', 'ret * 100')} USING (thr, slip)"""))
def _(t):
    d = b.slippage_grid(bets(t), "p", "pm", "y", "sec", ["sec", "id"], [0.1, 0.2], [0.0, 0.01, 0.03])
    return r(r(d, "total_pnl", "max_drawdown", digits=3), "hit_rate", "sharpe")


@query("B05_kelly_compound", BT(f""", k AS (SELECT *, p - pm > 0.1 AS fo, least(greatest(pm, 0.001), 0.999) AS m FROM bt WHERE abs(p - pm) > 0.1),
  k2 AS (SELECT *, CASE WHEN fo THEN p ELSE 1 - p END AS pp, CASE WHEN fo THEN m ELSE 1 - m END AS paid, CASE WHEN fo THEN y ELSE 1 - y END AS won FROM k),
  k3 AS (SELECT *, least(greatest(((1 / paid - 1) * pp - (1 - pp)) / (1 / paid - 1), 0), 0.01) AS f, won / paid - 1 AS rr FROM k2)
  SELECT count(*) AS triggers, sum((f > 0 AND rr > 0)::INTEGER)::BIGINT AS wins, round(sum(ln(1 + f * rr)), 5) AS log_growth, round(least(1.0, exp((SELECT lo FROM {dd_sql('k3', '', 'ln(1 + f * rr)')}))) * 10000, 3) AS min_bankroll FROM k3"""))
def _(t):
    d = b.kelly_compound(bets(t), "p", "pm", "y", "sec", ["sec", "id"], 0.1, cap=0.01)
    return d.select("triggers", "wins", F.round("log_growth", 5).alias("log_growth"), F.round("min_bankroll", 3).alias("min_bankroll"))


@query("B06_pnl_by", BT(f" SELECT market, count(*) AS n, round(avg(y), 6) AS hit_rate, round(sum({PNL}), 3) AS total_pnl FROM bt GROUP BY 1"))
def _(t):
    return r(r(b.pnl_by(bets(t), "market", "c", "y"), "total_pnl", digits=3), "hit_rate")


@query("B07_crowd_masks", T("SELECT market, sum(f::INTEGER)::BIGINT AS follow_crowd, sum((NOT f)::INTEGER)::BIGINT AS contrarian, sum((f AND side_buy = 1)::INTEGER)::BIGINT AS buy_majority FROM (SELECT *, (side_buy * outcome_yes + (1 - side_buy) * (1 - outcome_yes)) = (price > 0.5)::INTEGER AS f FROM t) GROUP BY 1"))
def _(t):
    d = b.crowd_masks(trades(t), "side_buy", "outcome_yes", "price")
    return d.groupBy("market").agg(*[F.sum(c).alias(c) for c in ("follow_crowd", "contrarian", "buy_majority")])


@query("B07b_signature_filter", BT(""", x AS (SELECT *, (rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0) / count(*) OVER () AS rk FROM bt)
  SELECT id, round(rk, 6) AS p_rank FROM x WHERE ttd < 21600 AND pm < 0.3 AND id % 40 < 20 AND usd > 1000"""))
def _(t):
    d = bets(t).withColumn("prior_n", F.col("id") % 40)
    return r(b.signature_filter(d, "p", "ttd", "pm", "prior_n", "usd"), "p_rank").select("id", "p_rank")


@query("B08_sensitivity_summary", BT(""", g AS (SELECT market AS model, strategy, st AS setting, avg(CASE WHEN y = 1 THEN (1 - c) / c ELSE -1 END) AS roi FROM (SELECT *, 'ev' AS strategy FROM bt), (SELECT unnest([0.0::DOUBLE, 0.1, 0.2]) AS st) WHERE edge > st GROUP BY ALL)
  SELECT model, strategy, round(max(roi), 6) AS best_roi, arg_max(setting, roi) AS best_setting, round(min(roi), 6) AS worst_roi, arg_min(setting, roi) AS worst_setting, round(avg(roi), 6) AS mean_roi FROM g GROUP BY ALL"""))
def _(t):
    d = bets(t).withColumn("setting", F.explode(F.array(F.lit(0.0), F.lit(0.1), F.lit(0.2)))).where("edge > setting")
    c = F.col("c")
    res = d.groupBy(F.col("market").alias("model"), F.lit("ev").alias("strategy"), "setting").agg(
        F.avg(F.when(F.col("y") == 1, (1 - c) / c).otherwise(-1.0)).alias("roi"))
    return r(b.sensitivity_summary(res, "model", "strategy", "roi", "setting"), "best_roi", "worst_roi", "mean_roi")


DAY = "d AS (SELECT event_type AS k, CAST(ts AS DATE) AS day, sum(value) AS v FROM events GROUP BY ALL), rt AS (SELECT *, v / lag(v) OVER (PARTITION BY k ORDER BY day) - 1 AS ret FROM d)"


def day_returns(t):
    d = t.events.groupBy(F.col("event_type").alias("k"), F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    return w.returns(d, "k", "day", "v")


@query("B09_position_pnl", f"""WITH {DAY}, p AS (SELECT *, (day(day) % 3 > 0)::INTEGER AS pos FROM rt), x AS (SELECT *, abs(pos - lag(pos, 1, 1) OVER (PARTITION BY k ORDER BY day)) AS sw FROM p),
  n AS (SELECT *, pos * coalesce(ret, 0) * 0.1 - sw * 0.001 AS net FROM x) SELECT k, day, sw::INTEGER AS switched, round(net, 6) AS net, round(exp(sum(ln(1 + net)) OVER (PARTITION BY k ORDER BY day)) - 1, 6) AS growth FROM n""")
def _(t):
    d = day_returns(t).withColumns({"pos": (F.dayofmonth("day") % 3 > 0).cast("int"), "rs": F.col("ret") * 0.1})
    return r(b.position_pnl(d, "k", "day", "pos", "rs"), "net", "growth").select("k", "day", "switched", "net", "growth")


@query("B10_weight_grid", f"""WITH {DAY}, p AS (SELECT a.day, coalesce(a.ret, 0) * 0.1 AS ra, coalesce(b.ret, 0) * 0.1 AS rb FROM rt a JOIN rt b USING (day) WHERE a.k = 'click' AND b.k = 'view'),
  g AS (SELECT round(i / 20.0, 4)::DOUBLE AS weight, day, i / 20.0::DOUBLE * ra + (1 - i / 20.0::DOUBLE) * rb AS ret FROM p, (SELECT unnest(generate_series(0, 20)) AS i)),
  c AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY weight ORDER BY day)) AS gr FROM g), e AS (SELECT *, gr / max(gr) OVER (PARTITION BY weight ORDER BY day) - 1 AS dd FROM c)
  SELECT weight, round(arg_max(gr, day) - 1, 6) AS terminal, round(stddev_samp(ret) * sqrt(252), 6) AS ann_vol, round(min(dd), 6) AS max_drawdown, round(-quantile_cont(ret, 0.05), 6) AS var_95, round(avg(ret) * 252 / (stddev_samp(ret) * sqrt(252)), 6) AS sharpe FROM e GROUP BY weight""")
def _(t):
    d = day_returns(t).withColumn("rs", F.col("ret") * 0.1)
    a = d.where("k = 'click'").select("day", F.col("rs").alias("ra"))
    x = a.join(d.where("k = 'view'").select("day", F.col("rs").alias("rb")), "day")
    return r(b.weight_grid(x, "day", "ra", "rb"), "terminal", "ann_vol", "max_drawdown", "var_95", "sharpe")


@query("B11_risk_summary", f"WITH {DAY} SELECT k, round(avg(ret) * 252, 6) AS ann_return, round(stddev_samp(ret) * sqrt(252), 6) AS ann_vol, round(avg(ret) * 252 / (stddev_samp(ret) * sqrt(252)), 6) AS sharpe, round(skewness(ret), 6) AS skew, round(kurtosis(ret), 6) AS kurt FROM rt WHERE ret IS NOT NULL GROUP BY k")
def _(t):
    return r(b.risk_summary(day_returns(t).where("ret IS NOT NULL"), "ret", by="k"), "ann_return", "ann_vol", "sharpe", "skew", "kurt")


@query("B12_var_cvar", f"WITH {DAY}, q AS (SELECT k, quantile_cont(ret, 0.05) AS a, quantile_cont(ret, 0.01) AS z FROM rt GROUP BY k) SELECT k, round(-any_value(a), 6) AS var_95, round(-avg(ret) FILTER (ret <= a), 6) AS cvar_95, round(-any_value(z), 6) AS var_99, round(-avg(ret) FILTER (ret <= z), 6) AS cvar_99 FROM rt JOIN q USING (k) GROUP BY k")
def _(t):
    return r(b.var_cvar(day_returns(t), "ret", (0.95, 0.99 + 0.0), "k"), "var_95", "cvar_95", "var_99", "cvar_99")


@query("B13_horizon_stats", f"""WITH {DAY}, h AS (SELECT k, hz AS horizon, CASE hz WHEN 3 THEN lead(v, 3) OVER w WHEN 7 THEN lead(v, 7) OVER w ELSE lead(v, 14) OVER w END / v - 1 AS roi
  FROM d, (SELECT unnest([3, 7, 14]) AS hz) WINDOW w AS (PARTITION BY k, hz ORDER BY day)) SELECT k, horizon, round(avg(roi), 6) AS mean, round(median(roi), 6) AS median, round(avg((roi > 0)::INTEGER), 6) AS p_positive, round(min(roi), 6) AS min, round(max(roi), 6) AS max FROM h WHERE roi IS NOT NULL GROUP BY ALL""")
def _(t):
    d = b.horizon_stats(day_returns(t).drop("ret"), "k", "day", "v", (3, 7, 14))
    return r(d, "mean", "median", "p_positive", "min", "max")


YS = "y AS (SELECT o_orderstatus AS k, year(o_orderdate)::INTEGER AS yr, count(*) AS v FROM orders GROUP BY ALL)"


def yearly(t):
    return t.orders.groupBy(F.col("o_orderstatus").alias("k"), F.year("o_orderdate").alias("yr")).agg(F.count("*").alias("v"))


@query("B14_project_linear", f"""WITH {YS}, x AS (SELECT *, v - lag(v) OVER (PARTITION BY k ORDER BY yr) AS d, max(yr) OVER (PARTITION BY k) AS t0 FROM y),
  g AS (SELECT k, any_value(t0) AS t0, arg_max(v, yr) AS v0, stddev_samp(d) AS sd, avg(d) FILTER (yr > t0 - 4) AS st FROM x GROUP BY k)
  SELECT k, i::INTEGER AS yr, round(v0 + st * (i - t0), 4) AS projected, round(v0 + st * (i - t0) - 1.96 * sd * sqrt(i - t0), 4) AS lower, round(v0 + st * (i - t0) + 1.96 * sd * sqrt(i - t0), 4) AS upper FROM g, (SELECT unnest(generate_series(1990, 2010)) AS i) WHERE i >= t0""")
def _(t):
    return r(b.project_linear(yearly(t), "k", "yr", "v", 5, 2010), "projected", "lower", "upper", digits=4)


# ---- Y ----
MS = """m AS (SELECT n_name AS k, (year(o_orderdate) * 12 + month(o_orderdate) - 1)::INTEGER AS t, round(sum(o_totalprice), 2) AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""


def monthly(t):
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    d = d.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return d.groupBy(F.col("n_name").alias("k"), (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).alias("t")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("v"))


def M(body):
    return f"WITH {MS}{body}"


WK = "(PARTITION BY k ORDER BY t)"


@query("Y01_resample", "SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS period, round(sum(value), 4) AS total, max(value) AS peak FROM events GROUP BY ALL")
def _(t):
    d = y.resample(t.events, "event_type", "ts", "day", {"total": F.sum("value"), "peak": F.max("value")})
    return r(d, "total", digits=4)


@query("Y02_aggregate_keys", "SELECT n_regionkey, year(o_orderdate)::INTEGER AS yr, round(sum(o_totalprice), 2) AS o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def _(t):
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return r(y.aggregate_keys(d.withColumn("yr", F.year("o_orderdate")), "n_regionkey", "yr", "o_totalprice"), "o_totalprice", digits=2)


@query("Y03_lag_pairs", M(" SELECT k, t, lag, lagged, value FROM (" + " UNION ALL ".join(f"SELECT k, t, {i} AS lag, lag(v, {i}) OVER {WK} AS lagged, v AS value FROM m" for i in range(1, 5)) + ") WHERE lagged IS NOT NULL"))
def _(t):
    return y.lag_pairs(monthly(t), "k", "t", "v", range(1, 5))


ACF = f""", x AS (SELECT *, v - avg(v) OVER (PARTITION BY k) AS x FROM m), l AS (SELECT *, {', '.join(f'lag(x, {i}) OVER {WK} AS l{i}' for i in range(1, 13))} FROM x),
  a AS ({' UNION ALL '.join(f'SELECT k, {i} AS lag, sum(x * l{i}) / sum(x * x) AS acf, count(*) AS n FROM l GROUP BY k' for i in range(1, 13))})"""


@query("Y04_acf", M(f"{ACF} SELECT k, lag, round(acf, 6) AS acf, n, round(1.959963984540054 / sqrt(n), 6) AS bound FROM a"))
def _(t):
    return r(y.acf(monthly(t), "k", "t", "v", 12), "acf", "bound")


@query("Y05_pacf", f"WITH RECURSIVE {MS}{ACF}" + """, g AS (SELECT k, list(acf ORDER BY lag) AS r FROM a GROUP BY k),
  p(k, r, i, phi, last) AS (SELECT k, r, 1, [r[1]], r[1] FROM g UNION ALL SELECT k, r, i + 1, list_append(list_transform(generate_series(1, i), lambda j: phi[j] - lst * phi[i + 1 - j]), lst), lst FROM
  (SELECT *, (r[i + 1] - list_sum(list_transform(generate_series(1, i), lambda j: phi[j] * r[i + 1 - j]))) / (1 - list_sum(list_transform(generate_series(1, i), lambda j: phi[j] * r[j]))) AS lst FROM p WHERE i < 8))
  SELECT k, i AS lag, round(last, 6) AS pacf FROM p""")
def _(t):
    return r(y.pacf(monthly(t), "k", "t", "v", 8), "pacf")


@query("Y06_difference", M(f" SELECT k, t, round(ln(v) - lag(ln(v), 12) OVER {WK}, 6) AS diff FROM m"))
def _(t):
    return r(y.difference(monthly(t), "k", "t", "v", 12, True), "diff").select("k", "t", "diff")


@query("Y07_decompose", M(f""", f AS (SELECT *, CASE WHEN count(v) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) = 13 THEN
  (sum(v) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) + (lag(v, 6) OVER {WK} + lead(v, 6) OVER {WK}) / 2) / 12 END AS trend, t % 12 AS s FROM m),
  ss AS (SELECT k, s, avg(v - trend) AS raw FROM f GROUP BY ALL), se AS (SELECT k, s, raw - avg(raw) OVER (PARTITION BY k) AS seasonal FROM ss)
  SELECT k, t, round(trend, 3) AS trend, round(seasonal, 3) AS seasonal, round(v - trend - seasonal, 3) AS remainder FROM f JOIN se USING (k, s)"""))
def _(t):
    d = y.decompose(monthly(t), "k", "t", "v", 12, season=F.col("t") % 12)
    return r(d, "trend", "seasonal", "remainder", digits=3).select("k", "t", "trend", "seasonal", "remainder")


@query("Y08_seasonal_table", M(" SELECT (t % 12 + 1)::INTEGER AS month, " + ", ".join(f'round(sum(v) FILTER (t // 12 = {yy}), 2) AS "{yy}"' for yy in (1998, 1999, 2000)) + ", round(avg(v), 2) AS season_mean FROM m GROUP BY 1"))
def _(t):
    d = monthly(t).withColumns({"month": (F.col("t") % 12 + 1).cast("int"), "yr": F.floor(F.col("t") / 12)})
    return r(y.seasonal_table(d, None, "month", "yr", "v", [1998, 1999, 2000]), "1998", "1999", "2000", "season_mean", digits=2)


@query("Y09_ljung_box", M(f"{ACF} SELECT k, round(sum(n * (n + 2) * acf * acf / (n - lag)), 5) AS stat, round(exp(-sum(n * (n + 2) * acf * acf / (n - lag)) / 2) * ({' + '.join(f'pow(sum(n * (n + 2) * acf * acf / (n - lag)) / 2, {i}) / {__import__('math').factorial(i)}' for i in range(6))}), 6) AS p_value FROM a GROUP BY k"))
def _(t):
    return r(r(y.ljung_box(monthly(t), "k", "t", "v", 12), "p_value"), "stat", digits=5)


@query("Y10_kpss", M(f""", e AS (SELECT k, t, v - avg(v) OVER (PARTITION BY k) AS e FROM m), s AS (SELECT *, sum(e) OVER {WK} AS s, lag(e, 1) OVER {WK} AS l1, lag(e, 2) OVER {WK} AS l2, lag(e, 3) OVER {WK} AS l3 FROM e)
  SELECT k, round(sum(s * s) / (count(*) * count(*)) / ((sum(e * e) + 2 * 0.75 * sum(e * l1) + 2 * 0.5 * sum(e * l2) + 2 * 0.25 * sum(e * l3)) / count(*)), 6) AS kpss, count(*) AS n FROM s GROUP BY k"""))
def _(t):
    return r(y.kpss(monthly(t), "k", "t", "v", 3), "kpss")


@query("Y10b_kpss_trend", M(f""", i AS (SELECT *, row_number() OVER {WK} AS i FROM m), f AS (SELECT k, regr_slope(v, i) AS b, regr_intercept(v, i) AS a FROM i GROUP BY k), e AS (SELECT k, t, v - a - b * i AS e FROM i JOIN f USING (k)),
  s AS (SELECT *, sum(e) OVER {WK} AS s, lag(e, 1) OVER {WK} AS l1 FROM e) SELECT k, round(sum(s * s) / (count(*) * count(*)) / ((sum(e * e) + 2 * 0.5 * sum(e * l1)) / count(*)), 6) AS kpss, count(*) AS n FROM s GROUP BY k"""))
def _(t):
    return r(y.kpss(monthly(t), "k", "t", "v", 1, "trend"), "kpss")


@query("Y11_adf", M(f""", d AS (SELECT k, v - lag(v) OVER {WK} AS d, lag(v) OVER {WK} AS l FROM m), g AS (SELECT k, count(d) AS n, regr_slope(d, l) AS b, regr_sxx(d, l) AS sxx, regr_syy(d, l) AS syy, regr_sxy(d, l) AS sxy FROM d GROUP BY k)
  SELECT k, round(b / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx), 4) AS adf, n, -2.86::DOUBLE AS crit_5pct, (b / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) < -2.86)::INTEGER AS stationary FROM g"""))
def _(t):
    return r(y.adf(monthly(t), "k", "t", "v", 0), "adf", digits=4)


@query("Y11b_adf_lags")
def _(t):
    return r(y.adf(monthly(t), "k", "t", "v", 2, "trend"), "adf", digits=4)


FC = f""", g AS (SELECT k, avg(v) AS mean, arg_max(v, t) AS last, arg_min(v, t) AS first, max(t) AS t0, count(*) AS n, list(v ORDER BY t) AS vs FROM tr GROUP BY k),
  fc AS (SELECT k, t0 + h AS t, h, method, CASE method WHEN 'mean' THEN mean WHEN 'naive' THEN last WHEN 'drift' THEN last + h * (last - first) / (n - 1) ELSE vs[len(vs) - 12 + (h - 1) % 12 + 1] END AS forecast
  FROM g, (SELECT unnest(generate_series(1, 12))::INTEGER AS h), (SELECT unnest(['mean', 'naive', 'drift', 'snaive']) AS method))"""


@query("Y12_benchmark_forecast", M(f", tr AS (SELECT * FROM m){FC} SELECT k, t, h, method, round(forecast, 3) AS forecast FROM fc"))
def _(t):
    return r(y.benchmark_forecast(monthly(t), "k", "t", "v", 12, 12), "forecast", digits=3)


CUT = 2000 * 12 + 6


@query("Y13_forecast_accuracy", M(f""", tr AS (SELECT * FROM m WHERE t < {CUT}){FC}, sc AS (SELECT k, avg(abs(e)) AS sc FROM (SELECT k, v - lag(v, 12) OVER {WK} AS e FROM tr) GROUP BY k)
  SELECT k, method, round(sqrt(avg((v - forecast) * (v - forecast))), 2) AS rmse, round(avg(abs(v - forecast)), 4) AS mae, round(avg(abs((v - forecast) / v)) * 100, 5) AS mape, round(1 - sum((v - forecast) * (v - forecast)) / (var_pop(v) * count(v)), 5) AS r2, round(avg(abs(v - forecast) / sc), 6) AS mase
  FROM fc JOIN m USING (k, t) JOIN sc USING (k) GROUP BY ALL"""))
def _(t):
    m = monthly(t)
    tr = m.where(F.col("t") < CUT)
    d = y.forecast_accuracy(y.benchmark_forecast(tr, "k", "t", "v", 12, 12), m, tr, "k", "t", "v", 12)
    return r(r(r(r(d, "rmse", digits=2), "mae", digits=4), "mape", "r2", digits=5), "mase")


@query("Y14_trend_season_regression")
def _(t):
    d = monthly(t).withColumn("s", F.col("t") % 12)
    x = y.trend_season_regression(d, "k", "t", "v", "s", range(12), {"event_1998": F.floor(F.col("t") / 12) == 1998})
    return r(x, "beta", "se", "t", "pct_effect", "r2", "sigma")


@query("Y15_piecewise_trend")
def _(t):
    return r(y.piecewise_trend(monthly(t).withColumn("t", F.col("t") - 23940), "k", "t", "v", [24, 48]), "beta", "se", "t", "r2", "sigma", digits=4)


@query("Y16_scenario_predict", f"""WITH {YS}, g AS (SELECT k, count(*) AS n, regr_slope(v, yr) AS b, regr_intercept(v, yr) AS a, avg(yr) AS mx, regr_sxx(v, yr) AS sxx, regr_syy(v, yr) AS syy, regr_sxy(v, yr) AS sxy FROM y GROUP BY k HAVING count(*) > 2),
  h AS (SELECT *, a + b * x0 AS fit, {T_SQL.format(dof='(n - 2)')} * sqrt((syy - sxy * sxy / sxx) / (n - 2) * (1 + 1.0 / n + (x0 - mx) * (x0 - mx) / sxx)) AS half FROM g, (VALUES ('low', 2002), ('high', 2010)) z(sc, x0))
  SELECT k, sc AS scenario, round(fit, 3) AS fit, round(fit - half, 3) AS lower, round(fit + half, 3) AS upper FROM h""")
def _(t):
    d = y.scenario_predict(yearly(t), "k", "v", "yr", {"low": 2002, "high": 2010})
    return r(d, "fit", "lower", "upper", digits=3).select("k", "scenario", "fit", "lower", "upper")


@query("Y17_ets_ses", f"WITH RECURSIVE {MS}" + """, g AS (SELECT k, list(v ORDER BY t) AS vs FROM m GROUP BY k),
  p(k, vs, a, i, l, sse) AS (SELECT k, vs, a, 1, vs[1], 0.0::DOUBLE FROM g, (SELECT unnest([0.1::DOUBLE, 0.3, 0.5, 0.7, 0.9]) AS a) UNION ALL SELECT k, vs, a, i + 1, a * vs[i + 1] + (1 - a) * l, sse + (vs[i + 1] - l) * (vs[i + 1] - l) FROM p WHERE i < len(vs)),
  f AS (SELECT k, a, l, sse, row_number() OVER (PARTITION BY k ORDER BY sse) AS rn FROM p WHERE i = len(vs))
  SELECT k, a AS alpha, round(sqrt(sse), 2) AS root_sse, h, round(l, 2) AS forecast FROM f, (SELECT unnest([1, 2, 3]) AS h) WHERE rn = 1""")
def _(t):
    d = y.ets(monthly(t), "k", "t", "v", "ses", 3)
    return d.select("k", "alpha", F.round(F.sqrt("sse"), 2).alias("root_sse"), "h", F.round("forecast", 2).alias("forecast"))


@query("Y17b_ets_holt_winters")
def _(t):
    m = monthly(t)
    parts = [y.ets(m, "k", "t", "v", kind, 12, 12 if kind == "hw" else 1, multiplicative=mult).withColumn("model", F.lit(name))
             for name, kind, mult in (("holt", "holt", False), ("damped", "damped", False), ("hw_add", "hw", False), ("hw_mult", "hw", True))]
    from functools import reduce
    d = reduce(lambda a, c: a.unionByName(c), parts)
    return r(d, "sse", "forecast", digits=2)


@query("Y18_forecast_cv", M(""", f AS (SELECT *, 23940 + 36 + fold * 6 AS o FROM m, (SELECT unnest(generate_series(0, 3)) AS fold)), g AS (SELECT k, fold, avg(v) AS mean, arg_max(v, t) AS last, arg_min(v, t) AS first, max(t) AS t0, count(*) AS n FROM f WHERE t < o GROUP BY ALL),
  e AS (SELECT k, method, v, CASE method WHEN 'mean' THEN mean WHEN 'naive' THEN last ELSE last + (t - t0) * (last - first) / (n - 1) END AS fc FROM f JOIN g USING (k, fold), (SELECT unnest(['mean', 'naive', 'drift']) AS method) WHERE t >= o AND t < o + 6 AND t <= t0 + 6)
  SELECT k, method, round(sqrt(avg((v - fc) * (v - fc))), 2) AS rmse, round(avg(abs(v - fc)), 5) AS mae, round(avg(abs((v - fc) / v)) * 100, 5) AS mape, round(1 - sum((v - fc) * (v - fc)) / (var_pop(v) * count(v)), 5) AS r2 FROM e GROUP BY ALL"""))
def _(t):
    d = y.forecast_cv(monthly(t), "k", "t", "v", 23940 + 36, 6, 4, 6)
    return r(r(r(d, "rmse", digits=2), "mae", digits=5), "mape", "r2", digits=5)


@query("Y19_guerrero", M(""", b AS (SELECT *, (row_number() OVER (PARTITION BY k ORDER BY t DESC) - 1) // 12 AS blk FROM m), s AS (SELECT k, blk, avg(v) AS mu, stddev_samp(v) AS sd FROM b GROUP BY ALL HAVING count(*) = 12),
  c AS (SELECT k, la, stddev_samp(sd / pow(mu, 1 - la)) / avg(sd / pow(mu, 1 - la)) AS cv FROM s, (SELECT unnest([-0.5::DOUBLE, 0, 0.5, 1, 1.5, 2]) AS la) GROUP BY ALL) SELECT k, arg_min(la, cv) AS "lambda", round(min(cv), 6) AS cv FROM c GROUP BY k"""))
def _(t):
    return r(y.guerrero(monthly(t), "k", "t", "v", 12, [-0.5, 0.0, 0.5, 1.0, 1.5, 2.0]), "cv")


@query("Y20_window_samples", M(" SELECT k, t, round(list_sum(win), 2) AS window_sum, target FROM (SELECT k, t, list(v) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS win, v AS target FROM m) WHERE len(win) = 24"))
def _(t):
    d = y.window_samples(monthly(t), "k", "t", "v", 24)
    return d.select("k", "t", F.round(F.aggregate("window", F.lit(0.0), lambda a, x: a + x), 2).alias("window_sum"), "target")


@query("Y21_mark_periods", T(", p AS (SELECT sec AS lo, sec + 1800 AS hi FROM t WHERE usd > 200) SELECT trade_id, EXISTS (SELECT 1 FROM p WHERE t.sec >= lo AND t.sec < hi)::INTEGER AS in_period FROM t"))
def _(t):
    d = trades(t)
    p = d.where("usd > 200").select(F.col("sec").alias("lo"), (F.col("sec") + 1800).alias("hi"))
    return y.mark_periods(d, "sec", p, "lo", "hi", ["sec"]).select("trade_id", "in_period")


# ---- Q ----
@query("Q01_check_counts", "SELECT 'row_count' AS check_name, 1 AS passed, count(*)::DOUBLE AS detail FROM labels UNION ALL SELECT 'class_balance', (avg(quality) BETWEEN 0.5 AND 0.95)::INTEGER, avg(quality) FROM labels")
def _(t):
    return q.check_counts(t.labels, t.labels.count(), "quality", 0.5, 0.95)


@query("Q02_check_cutoff", T("SELECT market, sum((sec >= 1705000000 + length(market) * 100000)::INTEGER)::BIGINT AS late_rows, (sum((sec >= 1705000000 + length(market) * 100000)::INTEGER) = 0)::INTEGER AS passed FROM t GROUP BY 1"))
def _(t):
    return q.check_cutoff(trades(t), "sec", F.lit(1705000000) + F.length("market") * 100000, "market")


@query("Q03_check_forbidden", "SELECT c AS \"column\", (c NOT IN (SELECT column_name FROM (DESCRIBE lineitem)))::INTEGER AS passed FROM (SELECT unnest(['l_tax', 'l_outcome', 'l_discount']) AS c)")
def _(t):
    return q.check_forbidden(t.lineitem, t.lineitem.columns, ["l_tax", "l_outcome", "l_discount"])


@query("Q04_check_lag", T("SELECT 'lag_match' AS check_name, (avg(ok) >= 0.995)::INTEGER AS passed, round(avg(ok), 6) AS detail FROM (SELECT (trade_id % 100 <> 0 OR abs(l) < 1e-6)::INTEGER AS ok FROM (SELECT trade_id, coalesce(lag(price) OVER (PARTITION BY taker ORDER BY ts, trade_id), 0.5) AS l FROM t))"))
def _(t):
    d = w.pre_trade_price(trades(t), "taker", out="stored").withColumn("stored", F.when(F.col("trade_id") % 100 == 0, 0.0).otherwise(F.col("stored")))
    return r(q.check_lag(d, "taker", "price", "stored", "sec", ("ts", "trade_id"), 0.5), "detail")


@query("Q05_check_point_in_time", """WITH o AS (SELECT o_custkey AS k, o_orderkey AS id, epoch(o_orderdate)::BIGINT AS sec, o_totalprice AS v FROM orders),
  w AS (SELECT count(*) OVER x AS c, coalesce(sum(v) OVER x, 0) AS a, k, sec FROM o WINDOW x AS (PARTITION BY k ORDER BY sec RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  e AS (SELECT k, sec, count(*) AS n, sum(v) AS s FROM o GROUP BY ALL), u AS (SELECT k, sec, coalesce(sum(n) OVER y, 0) AS c, coalesce(sum(s) OVER y, 0) AS a FROM e
  WINDOW y AS (PARTITION BY k ORDER BY sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT 'point_in_time' AS check_name, (avg((w.c = u.c AND abs(w.a - u.a) < 1e-4)::INTEGER) >= 0.99)::INTEGER AS passed, avg((w.c = u.c AND abs(w.a - u.a) < 1e-4)::INTEGER)::DOUBLE AS detail FROM w JOIN u USING (k, sec)""")
def _(t):
    from ..operators.joins import pit_event_features
    o = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", F.unix_timestamp("o_orderdate").alias("sec"))
    stored = pit_event_features(o, o, "o_custkey", "sec", "o_totalprice")
    return q.check_point_in_time(stored, o, "o_custkey", "sec", "o_totalprice", "o_orderkey", "pit_count", "pit_amount")


@query("Q06_check_alignment", "SELECT 'unmatched_keys' AS check_name, 0 AS passed, (SELECT count(*) FROM documents)::DOUBLE - (SELECT count(*) FROM labels) AS detail UNION ALL SELECT 'range_quality', ((SELECT count(*) FROM documents) = (SELECT count(*) FROM labels))::INTEGER, (SELECT count(*) FROM documents)::DOUBLE - (SELECT count(*) FROM labels)")
def _(t):
    return q.check_alignment(t.documents, t.labels.select("doc_id", F.col("quality").cast("double").alias("quality")), "doc_id", {"quality": (0.0, 1.0)})


@query("Q07_check_first_row", "SELECT 'count_starts_at_0' AS check_name, 1 AS passed, 0::DOUBLE AS detail UNION ALL SELECT 'small_first', (count(*) = 0)::INTEGER, count(*)::DOUBLE FROM (SELECT value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1) WHERE value >= 100")
def _(t):
    d = w.prior_count(trades(t), "taker")
    return q.check_first_row(d, "taker", "sec", ("ts", "trade_id"), {"count_starts_at_0": F.col("prior_count") == 0, "small_first": F.col("usd") < 100})


@query("Q08_check_null_rates", "WITH d AS (SELECT text, quality FROM documents LEFT JOIN labels USING (doc_id)) SELECT 'text' AS \"column\", 0.0::DOUBLE AS null_share, 0.0::DOUBLE AS bound, 1 AS passed UNION ALL SELECT 'quality', round(avg((quality IS NULL)::INTEGER), 6), 0.5, (avg((quality IS NULL)::INTEGER) <= 0.5)::INTEGER FROM d")
def _(t):
    return r(q.check_null_rates(t.documents.join(t.labels, "doc_id", "left"), {"text": 0.0, "quality": 0.5}), "null_share")


@query("Q09_check_structural_nulls", "WITH d AS (SELECT c_acctbal, quality, toxic FROM documents LEFT JOIN labels USING (doc_id) LEFT JOIN customer ON c_custkey = doc_id) SELECT 'filled_toxic' AS check_name, (sum((quality IS NULL AND toxic IS NOT NULL)::INTEGER) = 0)::INTEGER AS passed, sum((quality IS NULL AND toxic IS NOT NULL)::INTEGER)::DOUBLE AS detail FROM d UNION ALL SELECT 'negative_c_acctbal', (sum((c_acctbal < 0)::INTEGER) = 0)::INTEGER, sum((c_acctbal < 0)::INTEGER)::DOUBLE FROM d")
def _(t):
    d = t.documents.join(t.labels, "doc_id", "left").join(t.customer.withColumnRenamed("c_custkey", "doc_id"), "doc_id", "left")
    return q.check_structural_nulls(d, F.col("quality").isNotNull(), ["toxic"], ["c_acctbal"])


@query("Q10_check_duplicates", "SELECT coalesce(sum(n - 1), 0)::BIGINT AS surplus_rows, count(*) AS duplicate_keys FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def _(t):
    return q.check_duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("Q11_check_reconcile", "SELECT o_orderkey, round(coalesce(v, 0) / o_totalprice, 6) AS ratio FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_totalprice > 100000 AND NOT (coalesce(v, 0) / o_totalprice BETWEEN 0.5 AND 1.5)")
def _(t):
    l = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice")
    return r(q.check_reconcile(l, t.orders, "o_orderkey", "l_extendedprice", "o_totalprice", min_declared=100000.0), "ratio")


@query("Q12_check_domain", "SELECT role, count(*) AS n FROM conversations WHERE role NOT IN ('user', 'assistant') GROUP BY 1")
def _(t):
    return q.check_domain(t.conversations, "role", ["user", "assistant"])


@query("Q13_repair_report", "SELECT sum((b = 1 AND a = 0)::INTEGER)::BIGINT AS n_1_0, sum((b = 1 AND a = 1)::INTEGER)::BIGINT AS n_1_1, sum((b = 0 AND a = 1)::INTEGER)::BIGINT AS n_0_1, sum((a <> b)::INTEGER)::BIGINT AS changed, round(avg(a) - avg(b), 6) AS mean_change FROM (SELECT quality AS b, CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS a FROM labels)")
def _(t):
    a = t.labels.select("doc_id", F.when(F.col("doc_id") % 7 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("quality"))
    return r(q.repair_report(t.labels, a, "doc_id", "quality"), "mean_change")


@query("Q14_check_schema", "SELECT * FROM (VALUES ('doc_id', 'bigint', 'bigint', 1), ('quality', 'int', 'int', 1), ('toxic', 'string', 'int', 0), ('score', 'double', NULL, 0)) v(\"column\", expected, actual, passed)")
def _(t):
    return q.check_schema(t.labels, "doc_id bigint, quality int, toxic string, score double")
