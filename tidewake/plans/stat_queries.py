"""F, A, E and R queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as s, text as tx
from ..operators import aggregate as a, evaluate as e, project as p, sampling as sm
from .registry import query
from .trades import T_SQL, TRADES_SQL, r, trades


def T(body):
    return f"WITH {TRADES_SQL} {body}"


def U(x, seed=0):
    return f"(('0x' || substr(md5({x} || ':{seed}'), 1, 12))::BIGINT / 281474976710656::DOUBLE)"


PRED_SQL = f"""pr AS (SELECT o_orderkey AS id, o_custkey AS taker, o_orderpriority AS market, epoch(o_orderdate)::BIGINT AS sec,
  o_totalprice AS usd, (o_orderstatus = 'F')::INTEGER AS y, round(0.7 * {U('o_orderkey', 1)} + CASE WHEN o_orderstatus = 'F' THEN 0.3 ELSE 0.0 END, 3) AS p,
  round({U('o_orderkey', 2)}, 3) AS pm FROM orders)"""


def preds(t):
    y = (F.col("o_orderstatus") == "F").cast("int")
    return t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("taker"), F.col("o_orderpriority").alias("market"),
        F.unix_timestamp("o_orderdate").alias("sec"), F.col("o_totalprice").alias("usd"), y.alias("y"),
        F.round(0.7 * s.unit_hash("o_orderkey", seed=1) + F.when(y == 1, 0.3).otherwise(0.0), 3).alias("p"),
        F.round(s.unit_hash("o_orderkey", seed=2), 3).alias("pm")).cache()  # stands for a stored score table


def PR(body):
    return f"WITH {PRED_SQL} {body}"


# ---- F ----
@query("F01_num_transforms", "SELECT c_custkey, round(ln(1 + greatest(c_acctbal, 0)), 6) AS log1p, round(greatest(c_acctbal, 0), 4) AS expm1, round(tanh(c_acctbal / 1e4), 6) AS tanh, round(sqrt(abs(c_acctbal)), 6) AS root, sign(c_acctbal)::DOUBLE AS sign, abs(c_acctbal) AS size FROM customer")
def _(t):
    x = s.num_transforms("c_acctbal") | {"tanh": F.tanh(F.col("c_acctbal") / 1e4)}
    d = t.customer.select("c_custkey", *[v.alias(n) for n, v in x.items()])
    return r(r(d, "log1p", "tanh", "root"), "expm1", digits=4)


@query("F02_cyclical_time", """SELECT event_id, round(sin(hour(ts) * 2 * pi() / 24), 6) AS hour_sin, round(cos(hour(ts) * 2 * pi() / 24), 6) AS hour_cos,
  round(sin((isodow(ts) - 1) * 2 * pi() / 7), 6) AS dow_sin, round(cos((isodow(ts) - 1) * 2 * pi() / 7), 6) AS dow_cos,
  (hour(ts) >= 14 AND hour(ts) < 21)::INTEGER AS market_hours FROM events""")
def _(t):
    x = s.cyclical_time("ts")
    d = t.events.select("event_id", *[v.alias(n) for n, v in x.items()])
    return r(d, "hour_sin", "hour_cos", "dow_sin", "dow_cos")


@query("F03_deadline_features", T("""SELECT trade_id, ttd, round(ln(1 + ttd / 3600.0), 6) AS log_ttd_hours, (ttd < 86400)::INTEGER AS last_day,
  (ttd < 3600)::INTEGER AS last_hour, (ttd < 300)::INTEGER AS last_5min FROM (SELECT trade_id, greatest(1704067200 + k * 43200 - sec, 1)::BIGINT AS ttd FROM t)"""))
def _(t):
    d = trades(t).withColumn("dl", (F.lit(1704067200) + F.col("k") * 43200).cast("bigint"))
    return r(d.select("trade_id", *[v.alias(n) for n, v in s.deadline_features("sec", "dl").items()]), "log_ttd_hours")


@query("F04_probability_transforms", T("""SELECT trade_id, round(price * (1 - price), 6) AS implied_variance, round(least(price, 1 - price), 6) AS boundary_distance,
  round(abs(0.5 - price) * 2, 6) AS consensus_strength, round((2 * side_buy - 1) * (0.5 - price) * 2, 6) AS contrarian_score,
  (side_buy = 1 AND price < 0.2)::INTEGER AS long_shot_buy, round(abs(0.5 - price) * 2 * greatest((2 * side_buy - 1) * (0.5 - price) * 2, 0), 6) AS contrarian_strength FROM t"""))
def _(t):
    x = s.probability_transforms("price", "side_buy")
    d = trades(t).select("trade_id", *[v.alias(n) for n, v in x.items()])
    return r(d, *[n for n in x if n != "long_shot_buy"])


@query("F05_payoff", T("""SELECT trade_id, round(CASE WHEN side_buy = 1 THEN ln((1 - q) / q) ELSE -ln((1 - q) / q) END, 6) AS log_payoff,
  round(CASE WHEN side_buy = 1 THEN (1 - q) / q ELSE q / (1 - q) END, 6) AS risk_reward FROM (SELECT *, least(greatest(price, 0.01), 0.99) AS q FROM t)"""))
def _(t):
    x = s.payoff("price", "side_buy")
    return r(trades(t).select("trade_id", *[v.alias(n) for n, v in x.items()]), *x)


@query("F06_parse_deadline", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND month(o_orderdate) = 2 AND day(o_orderdate) = 29 THEN NULL
  WHEN o_orderkey % 3 = 0 THEN make_date(2026, month(o_orderdate), day(o_orderdate)) ELSE CAST(o_orderdate AS DATE) END AS deadline FROM orders""")
def _(t):
    day = F.date_format("o_orderdate", "MMMM d")
    q = F.concat(F.lit("Will it ship by "), F.when(F.col("o_orderkey") % 3 == 0, day).otherwise(
        F.concat(day, F.lit(", "), F.year("o_orderdate"))), F.lit("?"))
    return t.orders.select("o_orderkey", s.parse_deadline(q, 2026).alias("deadline"))


@query("F07_winning_side", T("SELECT trade_id, CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE CASE WHEN sec <= 1705000000 THEN 0 ELSE 1 END END::INTEGER AS winner FROM t"))
def _(t):
    m = F.col("k") % 4
    prices = F.when(m == 0, "['1', '0']").when(m == 1, '["0.001","0.999"]').when(m == 2, "['0.4','0.6']").otherwise("bad")
    return trades(t).select("trade_id", s.winning_side(prices, F.lit(1705000000), F.col("sec")).alias("winner"))


@query("F08_label_correct", T("SELECT trade_id, CASE WHEN k % 5 <> 0 THEN CASE WHEN side_buy = 1 THEN (outcome_yes = k % 2)::INTEGER ELSE (outcome_yes <> k % 2)::INTEGER END END AS correct FROM t"))
def _(t):
    d = trades(t).withColumn("winner", F.when(F.col("k") % 5 != 0, F.col("k") % 2))
    return d.select("trade_id", s.label_correct("side_buy", "outcome_yes", "winner").alias("correct"))


@query("F09_is_yes", T("SELECT trade_id, (k % 2 = 0)::INTEGER AS is_yes FROM t"))
def _(t):
    d = trades(t).withColumn("outs", F.when(F.col("k") % 3 == 0, " Yes ; No").otherwise("TRUE;FALSE"))
    return d.select("trade_id", s.is_yes("outs", F.col("k") % 2).alias("is_yes"))


@query("F10_side_probability", T("SELECT trade_id, round(CASE WHEN side_buy * outcome_yes + (1 - side_buy) * (1 - outcome_yes) = 1 THEN price ELSE 1 - price END, 6) AS p_side FROM t"))
def _(t):
    return r(trades(t).select("trade_id", s.side_probability("price", "side_buy", "outcome_yes").alias("p_side")), "p_side")


@query("F11_cost_edge", PR("SELECT id, round(least(greatest(pm, 0.05), 0.95), 6) AS cost, round(p - least(greatest(pm, 0.05), 0.95), 6) AS edge FROM pr"))
def _(t):
    x = s.cost_edge("p", "pm")
    return r(preds(t).select("id", *[v.alias(n) for n, v in x.items()]), *x)


@query("F12_bin_edges", PR("SELECT b, count(*) AS n FROM (SELECT CASE WHEN pm > 0 AND pm <= 0.1 THEN 'low' WHEN pm > 0.1 AND pm <= 0.5 THEN 'mid' WHEN pm > 0.5 AND pm <= 1 THEN 'high' END AS b FROM pr) GROUP BY b"))
def _(t):
    return preds(t).groupBy(s.bin_edges("pm", [0, 0.1, 0.5, 1.0], ["low", "mid", "high"]).alias("b")).agg(F.count("*").alias("n"))


def rx(x, *pairs):
    for pat, rep in pairs:
        x = f"regexp_replace({x}, '{pat}', '{rep}', 'g')"
    return x


@query("F13_normalise_text", "SELECT doc_id, md5(trim(" + rx("lower(text)", (r"http\S+|www\.\S+", ""), (r"\[redacted\s+\w+\]", ""), (r"[^a-z0-9\s.,!?''\-]", " "), (r"\.([a-z])", r". \1"), (r"\s+", " ")) + ")) AS h FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(tx.normalise_text("text")).alias("h"))


@query("F13b_drop_mentions", "SELECT doc_id, md5(trim(" + rx("lower(text)", (r"https?://\S+", " "), (r"@\w+", " "), (r"#(\w+)", r"\1"), (r"\s+", " ")) + ")) AS h FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(tx.drop_mentions("text")).alias("h"))


@query("F15b_sentences", r"""WITH s AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x) <> '') AS s FROM documents)
  SELECT doc_id, len(s)::BIGINT AS n, md5(array_to_string(s, '|')) AS h FROM s""")
def _(t):
    s_ = tx.sentences("text")
    return t.documents.select("doc_id", F.size(s_).cast("bigint").alias("n"), F.md5(F.array_join(s_, "|")).alias("h"))


@query("F14_apply_rules", "SELECT doc_id, length(" + rx("text", (r"(?i)\bthe\b", "a"), (r"(?i)\btion", "shun"), (r"(?i)\band\b", "plus")) + ") AS n FROM documents")
def _(t):
    rules = [(r"\bthe\b", "a"), (r"\btion", "shun"), (r"\band\b", "plus")]
    return t.documents.select("doc_id", F.length(tx.apply_rules("text", rules)).cast("bigint").alias("n"))


TOK = "regexp_extract_all(lower(text), '[a-z_]{2,}')"


@query("F15_tokenize", f"SELECT doc_id, len({TOK})::BIGINT AS n_tokens, array_to_string({TOK}[1:5], ' ') AS head FROM documents")
def _(t):
    k = tx.tokenize("text")
    return t.documents.select("doc_id", F.size(k).cast("bigint").alias("n_tokens"), F.array_join(F.slice(k, 1, 5), " ").alias("head"))


@query("F16_remove_stopwords", f"SELECT doc_id, len(list_filter({TOK}, lambda x: len(x) >= 4 AND NOT list_contains([{', '.join(chr(39) + w + chr(39) for w in tx.STOP_WORDS)}], x)))::BIGINT AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", F.size(tx.remove_stopwords(tx.tokenize("text"), min_len=4)).cast("bigint").alias("n"))


@query("F17_regex_find", r"SELECT doc_id, len(regexp_extract_all(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}'))::BIGINT AS n_ip, regexp_matches(text, '[A-Z][a-z]+ing\b')::INTEGER AS has_ing FROM documents")
def _(t):
    return t.documents.select("doc_id", F.size(tx.regex_find("text", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}")).cast("bigint").alias("n_ip"),
                              F.col("text").rlike(r"[A-Z][a-z]+ing\b").cast("int").alias("has_ing"))


PAGE_SQL = r"""p AS (SELECT page_id, html || chr(10) || '| a | b |' || chr(10) || '|:---|---:|' || chr(10) || '![x](y.png) ' || repeat('QUJD', 12) || '== data:image/png;base64,QUJD end' AS html FROM pages),
  l AS (SELECT page_id, list_filter(string_split(regexp_replace(html, 'data:[^;,\s]+;base64,[A-Za-z0-9+/=]*|!\[[^\]]*\]\([^)]*\)|<[^<>]*>', ' ', 'g'), chr(10)), lambda x: NOT regexp_matches(x, '^[\s|:+=-]*---[\s|:+=-]*$')) AS ls FROM p),
  w AS (SELECT page_id, array_to_string(list_transform(ls, lambda x: coalesce(array_to_string(list_filter(regexp_split_to_array(x, '\s+'), lambda y: y <> '' AND NOT regexp_matches(y, '^[A-Za-z0-9+/]{40,}={0,2}$')), ' '), '')), chr(10)) AS t FROM l),
  z AS (SELECT page_id, regexp_replace(regexp_replace(t, '\n\n+', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g') AS t FROM w)"""


@query("F18_sanitise_markup", f"WITH {PAGE_SQL} SELECT page_id, length(t) AS n, md5(t) AS digest FROM z")
def _(t):
    extra = "\n| a | b |\n|:---|---:|\n![x](y.png) " + "QUJD" * 12 + "== data:image/png;base64,QUJD end"
    d = t.pages.select("page_id", tx.sanitise_markup(F.concat("html", F.lit(extra))).alias("t"))
    return d.select("page_id", F.length("t").cast("bigint").alias("n"), F.md5("t").alias("digest"))


@query("F19_slugify", "SELECT event_id, regexp_replace(regexp_replace(lower(props || event_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM events")
def _(t):
    return t.events.select("event_id", tx.slugify(F.concat("props", "event_type")).alias("slug"))


@query("F20_excerpt", r"SELECT item_id, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')[1:5], ' ') AS head FROM benchmark")
def _(t):
    return t.benchmark.select("item_id", tx.excerpt("text", 5).alias("head"))


@query("F21_content_id", "SELECT doc_id, substr(sha1(text), 1, 12) AS id, sha256(text) AS digest FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.content_id("text").alias("id"), tx.content_id("text", "sha256", None).alias("digest"))


@query("F22_parse_number", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_totalprice WHEN 1 THEN round(o_totalprice, 0) * 1000 ELSE round(o_totalprice, 0) END AS v FROM orders")
def _(t):
    m = F.col("o_orderkey") % 3
    txt = F.when(m == 0, F.concat(F.lit("+"), F.format_number("o_totalprice", 2))).when(
        m == 1, F.concat(F.format_number(F.round("o_totalprice", 0), 0), F.lit("K"))).otherwise(
        F.concat(F.lit("."), F.format_number(F.round("o_totalprice", 0), 2)))
    return t.orders.select("o_orderkey", s.parse_number(txt).alias("v"))


@query("F23_signed_log", "SELECT c_custkey, round(sign(c_acctbal) * ln(1 + abs(c_acctbal)), 6) AS v FROM customer")
def _(t):
    return r(t.customer.select("c_custkey", s.signed_log("c_acctbal").alias("v")), "v")


@query("F24_box_cox", "SELECT p_partkey, round(ln(p_retailprice), 6) AS l0, round((pow(p_retailprice, 0.5) - 1) / 0.5, 6) AS l05 FROM part")
def _(t):
    return r(t.part.select("p_partkey", s.box_cox("p_retailprice", 0).alias("l0"), s.box_cox("p_retailprice", 0.5).alias("l05")), "l0", "l05")


@query("F25_grade_rank", "SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LARGE' THEN 2 END::BIGINT AS grade FROM part")
def _(t):
    return t.part.select("p_partkey", s.grade_rank("p_type", ["SMALL", "MEDIUM", "LARGE"]).alias("grade"))


@query("F26_to_config_json", """SELECT r_regionkey, '{"region":"' || r_name || '","nations":[' || string_agg('"' || n_name || '"', ',' ORDER BY n_name) || '],"n":' || count(*) || '}' AS config
  FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey, r_name""")
def _(t):
    d = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    parts = {"region": F.first("r_name"), "nations": F.sort_array(F.collect_set("n_name")), "n": F.count("*")}
    return a.to_config_json(d, "r_regionkey", parts)


# ---- A ----
@query("A01_group_size", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    return a.group_size(t.lineitem, "l_suppkey")


@query("A02_wallet_profile", "SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS max, arg_min(event_type, (ts, event_id)) AS first FROM events GROUP BY 1 HAVING count(*) >= 60")
def _(t):
    return r(a.wallet_profile(t.events, "user_id", "value", "event_type", F.struct("ts", "event_id"), 60), "mean")


@query("A03_describe_by", "SELECT l_returnflag, count(*) AS count, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, min(l_quantity) AS min, max(l_quantity) AS max, quantile_cont(l_quantity, 0.25) AS p25, quantile_cont(l_quantity, 0.5) AS p50, quantile_cont(l_quantity, 0.75) AS p75 FROM lineitem GROUP BY 1")
def _(t):
    return r(a.describe_by(t.lineitem, "l_returnflag", "l_quantity"), "mean", "std")


YEARS = list(range(1995, 2002))


@query("A04_pivot_sum", f"""SELECT n_name, {', '.join(f'round(coalesce(sum(o_totalprice) FILTER (year(o_orderdate) = {y}), 0), 2) AS "{y}"' for y in YEARS)}
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def _(t):
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    x = a.pivot_sum(d.withColumn("y", F.year("o_orderdate")), "n_name", "y", "o_totalprice", YEARS)
    return r(x, *map(str, YEARS), digits=2)


@query("A05_unpivot", "UNPIVOT (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME variable VALUE value")
def _(t):
    return a.unpivot(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax"),
                     ["l_orderkey", "l_linenumber", "l_partkey"], ["l_quantity", "l_discount", "l_tax"])


@query("A06_stack_unstack", """SELECT m.c_mktsegment, s.o_orderstatus, round(coalesce(sum(o_totalprice), 0), 2) AS o_totalprice FROM (SELECT DISTINCT c_mktsegment FROM customer) m, (SELECT DISTINCT o_orderstatus FROM orders) s
  LEFT JOIN (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey) o ON o.c_mktsegment = m.c_mktsegment AND o.o_orderstatus = s.o_orderstatus GROUP BY ALL""")
def _(t):
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return r(a.stack_unstack(d, "c_mktsegment", "o_orderstatus", "o_totalprice", ["F", "O", "P"]), "o_totalprice", digits=2)


@query("A07_value_share", "SELECT lang, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents)::DOUBLE, 6) AS share FROM documents GROUP BY 1")
def _(t):
    return r(a.value_share(t.documents, "lang"), "share")


@query("A08_rate_by", PR("SELECT market, year(to_timestamp(sec))::INTEGER AS yr, round(avg(y), 6) AS rate, count(y) AS n FROM pr GROUP BY ALL"))
def _(t):
    return r(a.rate_by(preds(t).withColumn("yr", F.year(F.timestamp_seconds("sec"))), ["market", "yr"], "y"), "rate")


NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("A09_corr_matrix", " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, round(corr({x}, {y}), 6) AS corr, round(covar_samp({x}, {y}), 4) AS cov FROM lineitem" for i, x in enumerate(NUM[:1] + NUM[2:]) for y in (NUM[:1] + NUM[2:])[i:]))
def _(t):
    d = a.corr_matrix(t.lineitem, NUM[:1] + NUM[2:])
    return r(r(d, "corr"), "cov", digits=4)


@query("A10_corr_with", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(corr({c}, l_extendedprice), 6) AS corr, (abs(corr({c}, l_extendedprice)) > 0.3)::INTEGER AS strong FROM lineitem" for c in ["l_quantity", "l_discount", "l_tax"]))
def _(t):
    return r(a.corr_with(t.lineitem, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"), "corr")


YR = "y AS (SELECT n_name AS k, year(o_orderdate)::INTEGER AS yr, sum(o_totalprice) AS v, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"


def yearly(t):
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return d.groupBy(F.col("n_name").alias("k"), F.year("o_orderdate").alias("yr")).agg(F.sum("o_totalprice").alias("v"), F.count("*").alias("n"))


@query("A11_corr_with_time", f"WITH {YR}, d AS (SELECT *, v - lag(v) OVER (PARTITION BY k ORDER BY yr) AS dv FROM y) SELECT k, round(corr(yr, v), 6) AS corr_level, round(corr(yr, dv), 6) AS corr_diff FROM d GROUP BY k")
def _(t):
    return r(a.corr_with_time(yearly(t), "k", "yr", "v"), "corr_level", "corr_diff")


@query("A12_moments", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(skewness({c}), 5) AS skew, round(kurtosis({c}), 5) AS kurt, (kurtosis({c}) > 3)::INTEGER AS fat_tail FROM {tb}" for c, tb in [("value", "events")]))
def _(t):
    return r(a.moments(t.events, ["value"]), "skew", "kurt", digits=5)


@query("A13_zero_density", "SELECT l_returnflag, 'l_discount' AS \"column\", round(avg((abs(l_discount) < 1e-12)::INTEGER), 6) AS zero_share FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'l_tax', round(avg((abs(l_tax) < 1e-12)::INTEGER), 6) FROM lineitem GROUP BY 1")
def _(t):
    return r(a.zero_density(t.lineitem, ["l_discount", "l_tax"], "l_returnflag"), "zero_share")


@query("A14_null_profile", "SELECT 'n' AS \"column\", round(avg((n IS NULL)::INTEGER), 6) AS null_share FROM (SELECT c_custkey, n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON c_custkey = o_custkey) UNION ALL SELECT 'c_custkey', 0.0::DOUBLE")
def _(t):
    n = t.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return r(a.null_profile(t.customer.select("c_custkey").join(n, "c_custkey", "left")), "null_share")


@query("A15_quantile_table", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", " + ", ".join(f"round(quantile_cont({c}, {q}), 6) AS p{n}" for q, n in [(0.01, "01"), (0.05, "05"), (0.95, "95"), (0.99, "99")]) + " FROM lineitem" for c in ["l_quantity", "l_extendedprice"]))
def _(t):
    return r(a.quantile_table(t.lineitem, ["l_quantity", "l_extendedprice"]), "p01", "p05", "p95", "p99")


@query("A16_mean_shift", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(abs(avg({c}) FILTER (l_linestatus = 'O') - avg({c}) FILTER (l_linestatus = 'F')) / sqrt((var_samp({c}) FILTER (l_linestatus = 'O') + var_samp({c}) FILTER (l_linestatus = 'F')) / 2), 6) AS shift FROM lineitem" for c in NUM))
def _(t):
    return r(a.mean_shift(t.lineitem, NUM, "l_linestatus", "F", "O"), "shift")


@query("A17_n_distinct", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS n_distinct FROM orders GROUP BY 1")
def _(t):
    return a.n_distinct(t.orders, "o_custkey", "o_orderpriority")


@query("A18_weighted_rating", """WITH i AS (SELECT l_partkey, count(*) AS v, avg(l_quantity) AS rt FROM lineitem GROUP BY 1), m AS (SELECT quantile_cont(v, 0.9) AS m, avg(rt) AS c FROM i)
  SELECT l_partkey, v, round(v / (v + m) * rt + m / (v + m) * c, 6) AS score FROM i, m WHERE v >= m""")
def _(t):
    i = t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("v"), F.avg("l_quantity").alias("rt"))
    return r(a.weighted_rating(i, "v", "rt"), "score").select("l_partkey", "v", "score")


@query("A19_ols_by", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    d = a.ols_by(t.lineitem, "l_returnflag", "l_extendedprice", "l_quantity")
    return r(r(r(d, "slope", digits=5), "intercept", digits=4), "r2")


@query("A20_ols_residuals", f"WITH {YR}, f AS (SELECT k, regr_slope(n, yr) AS b, regr_intercept(n, yr) AS a FROM y GROUP BY k) SELECT k, yr, round(n - (a + b * yr), 4) AS residual FROM y JOIN f USING (k)")
def _(t):
    return r(a.ols_residuals(yearly(t), "k", "n", "yr"), "residual", digits=4).select("k", "yr", "residual")


@query("A21_ols_predict", f"""WITH {YR}, g AS (SELECT k, count(*) AS c, regr_slope(n, yr) AS b, regr_intercept(n, yr) AS a, avg(yr) AS mx, regr_sxx(n, yr) AS sxx, regr_syy(n, yr) AS syy, regr_sxy(n, yr) AS sxy FROM y GROUP BY k HAVING count(*) > 2),
  h AS (SELECT *, a + b * 2002 AS fit, sqrt((syy - sxy * sxy / sxx) / (c - 2) * (1 + 1.0 / c + (2002 - mx) * (2002 - mx) / sxx)) AS se FROM g)
  SELECT k, round(fit, 3) AS fit, round(fit - q * se, 3) AS lower, round(fit + q * se, 3) AS upper FROM (SELECT *, {T_SQL.format(dof='(c - 2)')} AS q FROM h)""")
def _(t):
    return r(a.ols_predict(yearly(t), "k", "n", "yr", 2002), "fit", "lower", "upper", digits=3).select("k", "fit", "lower", "upper")


DAILY = "d AS (SELECT event_type AS k, CAST(ts AS DATE) AS day, sum(value) AS v FROM events GROUP BY ALL)"


def day_series(t):
    return t.events.groupBy(F.col("event_type").alias("k"), F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))


ODAY = "d AS (SELECT o_orderstatus AS k, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS v FROM orders GROUP BY ALL)"


def order_days(t):
    return t.orders.groupBy(F.col("o_orderstatus").alias("k"), F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("v"))


@query("A22_monthly_returns", f"""WITH {ODAY}, m AS (SELECT k, date_trunc('month', day) AS m, arg_max(v, day) / arg_min(v, day) - 1 AS ret FROM d GROUP BY ALL)
  SELECT k, month(m)::INTEGER AS month, round(avg(ret), 5) AS mean, round(median(ret), 5) AS median, count(ret) AS n FROM m GROUP BY ALL""")
def _(t):
    return r(a.monthly_returns(order_days(t), "k", "day", "v"), "mean", "median", digits=5)


@query("A23_dow_profile", f"WITH {ODAY} SELECT k, (isodow(day) - 1)::INTEGER AS dow, round(avg(v), 2) AS mean, count(v) AS n, round(median(v), 3) AS median FROM d GROUP BY ALL")
def _(t):
    return r(r(a.dow_profile(order_days(t), "k", "day", "v"), "mean", digits=2), "median", digits=3)


@query("A24_topn_share", "WITH g AS (SELECT l_suppkey, sum(l_quantity) AS v FROM lineitem GROUP BY 1) SELECT (SELECT sum(v) FROM (SELECT v FROM g ORDER BY v DESC, l_suppkey LIMIT 10)) AS top_total, sum(v) AS total, round((SELECT sum(v) FROM (SELECT v FROM g ORDER BY v DESC, l_suppkey LIMIT 10)) / sum(v), 6) AS share FROM g")
def _(t):
    return r(a.topn_share(t.lineitem, "l_suppkey", "l_quantity", 10), "share")


@query("A25_change_summary", f"WITH {YR}, c AS (SELECT k, arg_min(n, yr) AS s, arg_max(n, yr) AS e FROM y GROUP BY k) SELECT k, s AS start, e AS \"end\", e - s AS change, round((e - s) / s::DOUBLE * 100, 6) AS pct_change FROM c")
def _(t):
    return r(a.change_summary(yearly(t), "k", "yr", "n"), "pct_change")


@query("A26_boundary_gap", "SELECT year(l_shipdate)::INTEGER AS yr, sum(l_quantity) AS total, sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) AS covered, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS gap, round(sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS coverage FROM lineitem GROUP BY 1")
def _(t):
    return r(a.boundary_gap(t.lineitem.withColumn("yr", F.year("l_shipdate")), "yr", F.col("l_returnflag") != "R", "l_quantity"), "coverage")


@query("A26b_excluded_last", "SELECT l_linestatus, sum(l_quantity) AS excluded FROM lineitem WHERE l_returnflag = 'R' AND year(l_shipdate) = (SELECT max(year(l_shipdate)) FROM lineitem) GROUP BY 1")
def _(t):
    return a.excluded_last(t.lineitem.withColumn("yr", F.year("l_shipdate")), "yr", F.col("l_returnflag") != "R", "l_linestatus", "l_quantity")


@query("A27_conditional_rates", T("SELECT market, round(avg(outcome_yes) FILTER (side_buy = 1), 6) AS rate_1, round(avg(outcome_yes) FILTER (side_buy = 0), 6) AS rate_0, round(avg(outcome_yes) FILTER (side_buy = 1) - avg(outcome_yes) FILTER (side_buy = 0), 6) AS diff FROM t GROUP BY 1"))
def _(t):
    return r(a.conditional_rates(trades(t), "market", "side_buy", "outcome_yes"), "rate_1", "rate_0", "diff")


@query("A28_simpson_check", T("""SELECT market, count(*) AS cells, sum((coalesce(s, 0) = 0)::INTEGER)::BIGINT AS zero_variance, round(avg(m), 6) AS mean_of_means, round(stddev_samp(m), 6) AS std_of_means
  FROM (SELECT market, taker, avg(outcome_yes) AS m, stddev_samp(outcome_yes) AS s FROM t GROUP BY ALL) GROUP BY 1"""))
def _(t):
    return r(a.simpson_check(trades(t), "market", "taker", "outcome_yes"), "mean_of_means", "std_of_means")


@query("A29_kyle_lambda", T("""
, o AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY taker) AS c, price - lag(price) OVER w AS dp, CASE WHEN side_buy = 1 THEN usd ELSE -usd END AS sv FROM t WINDOW w AS (PARTITION BY taker ORDER BY ts, trade_id))
SELECT taker, regr_count(dp, sign(sv) * sqrt(abs(sv)))::BIGINT AS n, CASE WHEN regr_count(dp, sign(sv) * sqrt(abs(sv))) >= 20 THEN round(regr_slope(dp, sign(sv) * sqrt(abs(sv))), 6) ELSE 0 END AS kyle_lambda FROM o WHERE i - 1 < c // 2 GROUP BY taker"""))
def _(t):
    d = trades(t).withColumn("sv", F.when(F.col("side_buy") == 1, F.col("usd")).otherwise(-F.col("usd")))
    return r(a.kyle_lambda(d, "taker", "price", "sv", "sec", ("ts", "trade_id")), "kyle_lambda")


@query("A30_bucket_dispersion", T("""
, g AS (SELECT market, sec // 1800 AS b, stddev_samp(price) AS s FROM t GROUP BY ALL) SELECT trade_id, round(g.s, 5) AS dispersion, round(h.s, 5) AS prior_dispersion
FROM t LEFT JOIN g ON t.market = g.market AND t.sec // 1800 = g.b LEFT JOIN g h ON t.market = h.market AND t.sec // 1800 = h.b + 1"""))
def _(t):
    d = a.bucket_dispersion(trades(t), "market", "sec", "price", 30)
    d = a.bucket_dispersion(d, "market", "sec", "price", 30, True, "prior_dispersion")
    return r(d, "dispersion", "prior_dispersion", digits=5).select("trade_id", "dispersion", "prior_dispersion")


@query("A31_mutual_info", """WITH e AS (SELECT quantile_cont(l_quantity, [.1, .2, .3, .4, .5, .6, .7, .8, .9]) AS e FROM lineitem),
  b AS (SELECT len(list_filter(e, lambda x: x < l_quantity)) AS b, (l_returnflag = 'R')::INTEGER AS y FROM lineitem, e), g AS (SELECT b, y, count(*) AS n FROM b GROUP BY ALL)
  SELECT 'l_quantity' AS "column", round(sum(p), 8) AS mi FROM (SELECT n / (sum(n) OVER ())::DOUBLE * ln(n * (sum(n) OVER ())::DOUBLE / ((sum(n) OVER (PARTITION BY b))::DOUBLE * (sum(n) OVER (PARTITION BY y))::DOUBLE)) AS p FROM g)""")
def _(t):
    d = t.lineitem.select("l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return r(a.mutual_info(d, ["l_quantity"], "y"), "mi", digits=8)


@query("A32_entropy_by", "SELECT user_id, round(-sum(n / t::DOUBLE * ln(n / t::DOUBLE)), 6) AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY user_id) AS t FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type)) GROUP BY 1")
def _(t):
    return r(a.entropy_by(t.events, "user_id", "event_type"), "entropy")


@query("A33_event_window_counts", T("""
, e AS (SELECT event_id AS eid, epoch(ts)::BIGINT AS es FROM events WHERE value > 300), h AS (SELECT sec // 3600 AS h, count(*) AS n, sum(usd) AS v FROM t GROUP BY 1)
, x AS (SELECT event_id AS eid, CAST(floor(epoch(ts)) AS BIGINT) // 3600 AS eh FROM events WHERE value > 300)
SELECT eid, h.h - eh AS offset_hours, n, round(v, 4) AS volume FROM x JOIN h ON abs(h.h - eh) <= 48"""))
def _(t):
    d = trades(t)
    ev = d.where("usd > 300").select(F.col("trade_id").alias("eid"), F.col("sec").alias("es"))
    return r(a.event_window_counts(d, "sec", "usd", ev, "es", "eid"), "volume", digits=4)


@query("A33b_daily_volume", "SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS volume FROM events GROUP BY 1")
def _(t):
    return r(a.daily_volume(t.events, "ts", "value"), "volume", digits=4)


# ---- E ----
def auc_sql(src, p, by=None):
    part = f"PARTITION BY {by}" if by else ""
    sel = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f"""(SELECT {sel}CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN (sum(rk * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y))::DOUBLE END AS auc, count(*) AS n
      FROM (SELECT *, rank() OVER ({part} ORDER BY {p}) + (count(*) OVER (PARTITION BY {by + ', ' if by else ''}{p}) - 1) / 2.0 AS rk FROM {src}) {grp})"""


@query("E01_auc", PR(f"SELECT market, round(auc, 6) AS auc, n FROM {auc_sql('pr', 'p', 'market')}"))
def _(t):
    return r(e.auc(preds(t), "y", "p", "market"), "auc")


@query("E02_brier", PR("SELECT market, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(y), 6) AS base_rate, count(y) AS n FROM pr GROUP BY 1"))
def _(t):
    return r(e.brier(preds(t), "y", "p", "market"), "brier", "base_rate")


REL = "rel AS (SELECT market, least(floor(p * 10), 9)::INTEGER AS bin, avg(p) AS mean_p, avg(y) AS rate, count(y) AS n FROM pr GROUP BY ALL)"


@query("E03_ece", PR(f", {REL} SELECT market, round(sum(n * abs(mean_p - rate)) / sum(n), 6) AS ece FROM rel GROUP BY 1"))
def _(t):
    return r(e.ece(preds(t), "y", "p", 10, "market"), "ece")


@query("E04_reliability", PR(f", {REL} SELECT market, bin, round(mean_p, 6) AS mean_p, round(rate, 6) AS rate, n FROM rel"))
def _(t):
    return r(e.reliability(preds(t), "y", "p", 10, "market"), "mean_p", "rate")


@query("E05_classification_report", PR("""
, c AS (SELECT y::VARCHAR AS a, (p >= 0.5)::INTEGER::VARCHAR AS b FROM pr), l AS (SELECT DISTINCT a AS label FROM c),
k AS (SELECT label, count(*) FILTER (a = label) AS support, count(*) FILTER (b = label) AS g, count(*) FILTER (a = label AND b = label) AS h FROM c, l GROUP BY 1),
m AS (SELECT label, h / g::DOUBLE AS precision, h / support::DOUBLE AS recall, 2.0 * h / (g + support)::DOUBLE AS f1, support, h FROM k)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM m
UNION ALL SELECT 'accuracy', round(sum(h) / sum(support)::DOUBLE, 6), round(sum(h) / sum(support)::DOUBLE, 6), round(sum(h) / sum(support)::DOUBLE, 6), sum(support)::BIGINT FROM m
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM m
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support)::DOUBLE, 6), round(sum(recall * support) / sum(support)::DOUBLE, 6), round(sum(f1 * support) / sum(support)::DOUBLE, 6), sum(support)::BIGINT FROM m"""))
def _(t):
    d = preds(t).withColumn("yhat", (F.col("p") >= 0.5).cast("int"))
    return r(e.classification_report(d, "y", "yhat"), "precision", "recall", "f1")


@query("E05b_confusion", PR("SELECT y AS actual, (p >= 0.5)::INTEGER AS predicted, count(*) AS n FROM pr GROUP BY ALL"))
def _(t):
    return e.confusion(preds(t).withColumn("yhat", (F.col("p") >= 0.5).cast("int")), "y", "yhat")


@query("E06_average_precision", PR("""
, g AS (SELECT market, p, sum(y) AS pos, count(*) AS n FROM pr GROUP BY ALL), c AS (SELECT market, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS n FROM g WINDOW w AS (PARTITION BY market ORDER BY p DESC))
SELECT market, round(sum(pos * tp / n::DOUBLE) / sum(pos)::DOUBLE, 6) AS ap FROM c GROUP BY 1"""))
def _(t):
    return r(e.average_precision(preds(t), "y", "p", "market"), "ap")


@query("E07_regression_errors", """SELECT l_returnflag, round(sqrt(avg((y - f) * (y - f))), 4) AS rmse, round(avg(abs(y - f)), 4) AS mae, round(avg(abs((y - f) / y)) * 100, 6) AS mape,
  round(1 - sum((y - f) * (y - f)) / (var_pop(y) * count(y)), 6) AS r2, round(avg(abs(y - f) / 1000), 6) AS mase FROM (SELECT l_returnflag, l_extendedprice AS y, l_quantity * 1400 AS f FROM lineitem) GROUP BY 1""")
def _(t):
    d = t.lineitem.select("l_returnflag", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1400).alias("f"))
    return r(r(e.regression_errors(d, "y", "f", "l_returnflag", F.lit(1000.0)), "rmse", "mae", digits=4), "mape", "r2", "mase")


@query("E08_metrics_by", PR(f"SELECT m.taker, round(auc, 6) AS auc, m.n, round(b, 6) AS base_rate, round(mp, 6) AS mean_p FROM {auc_sql('pr', 'p', 'taker')} m JOIN (SELECT taker, avg(y) AS b, avg(p) AS mp FROM pr GROUP BY 1) g USING (taker) WHERE n >= 10"))
def _(t):
    return r(e.metrics_by(preds(t), "y", "p", "taker", 10), "auc", "base_rate", "mean_p")


@query("E09_feature_stability", PR(f""", a AS (SELECT 'p' AS feature, auc FROM {auc_sql('pr', 'p', 'market')} UNION ALL SELECT 'pm', auc FROM {auc_sql('pr', 'pm', 'market')})
  SELECT feature, count(auc) AS groups, sum((auc < 0.5)::INTEGER)::BIGINT AS below_half, sum((auc > 0.55)::INTEGER)::BIGINT AS above_055, round(quantile_cont(auc, 0.05), 6) AS p05, round(median(auc), 6) AS median, round(quantile_cont(auc, 0.95), 6) AS p95 FROM a GROUP BY 1"""))
def _(t):
    return r(e.feature_stability(preds(t), ["p", "pm"], "y", "market"), "p05", "median", "p95")


@query("E10_residual_edge", PR(f""", f AS (SELECT regr_slope(p, pm) AS b, regr_intercept(p, pm) AS a, corr(p, y) AS ry, corr(pm, y) AS rm, corr(p, pm) AS rx FROM pr),
  d AS (SELECT y, p - pm AS edge, p - (a + b * pm) AS res FROM pr, f)
  SELECT round((SELECT auc FROM {auc_sql('d', 'edge')}), 5) AS auc_edge, round((SELECT auc FROM {auc_sql('d', 'res')}), 5) AS auc_residual, round((ry - rm * rx) / sqrt((1 - rm * rm) * (1 - rx * rx)), 6) AS partial_corr FROM f"""))
def _(t):
    return r(r(e.residual_edge(preds(t), "p", "pm", "y"), "auc_edge", "auc_residual", digits=5), "partial_corr")


@query("E11_consensus_split", PR("""
, top AS (SELECT * FROM pr QUALIFY row_number() OVER (ORDER BY p DESC, id) <= greatest(1, floor(count(*) OVER () * 0.05)))
SELECT count(*) AS n, round(avg((pm > 0.5)::INTEGER), 6) AS with_share, round(avg(y) FILTER (pm > 0.5), 6) AS hit_with, round(avg(y) FILTER (NOT pm > 0.5), 6) AS hit_against, count(DISTINCT market) AS groups FROM top"""))
def _(t):
    return r(e.consensus_split(preds(t), "p", "pm", "y", "id", 0.05, "market"), "with_share", "hit_with", "hit_against")


@query("E12_seen_vs_novel", PR(f""", d AS (SELECT *, (taker IN (SELECT taker FROM pr WHERE sec < 800000000))::INTEGER AS seen FROM pr WHERE sec >= 800000000)
  SELECT m.seen, round(auc, 6) AS auc, m.n, round(b, 6) AS base_rate, round(mp, 6) AS mean_p FROM {auc_sql('d', 'p', 'seen')} m JOIN (SELECT seen, avg(y) AS b, avg(p) AS mp FROM d GROUP BY 1) g USING (seen)"""))
def _(t):
    d = preds(t)
    return r(e.seen_vs_novel(d.where("sec < 800000000"), d.where("sec >= 800000000"), "taker", "y", "p"), "auc", "base_rate", "mean_p")


@query("E13_hit_rate_by_edge", PR("SELECT b AS bucket, round(avg(y), 6) AS hit_rate, count(y) AS n FROM (SELECT y, CASE WHEN x > -1 AND x <= 0 THEN 'neg' WHEN x > 0 AND x <= 0.2 THEN 'low' WHEN x > 0.2 AND x <= 1 THEN 'high' END AS b FROM (SELECT y, round(p - pm, 6) AS x FROM pr)) WHERE b IS NOT NULL GROUP BY 1"))
def _(t):
    d = preds(t).withColumn("edge", F.round(F.col("p") - F.col("pm"), 6))
    return r(e.hit_rate_by_edge(d, "edge", "y", [-1, 0, 0.2, 1], ["neg", "low", "high"]), "hit_rate")


@query("E14_falsification", PR("""
, z AS (SELECT market AS strategy, avg(y) FILTER (p > 0.5) AS a, avg(y) FILTER (p > 0.3) AS b, avg(y) FILTER (pm > 0.5) AS n FROM pr GROUP BY 1)
SELECT strategy, CASE WHEN a > b THEN 'strict' ELSE 'wide' END AS best_model, round(greatest(a, b), 6) AS best_roi, round(n, 6) AS naive_roi, (greatest(a, b) > n)::INTEGER AS beats_naive FROM z"""))
def _(t):
    d = preds(t)
    res = d.groupBy(F.col("market").alias("strategy")).agg(
        F.avg(F.when(F.col("p") > 0.5, F.col("y"))).alias("strict"), F.avg(F.when(F.col("p") > 0.3, F.col("y"))).alias("wide"),
        F.avg(F.when(F.col("pm") > 0.5, F.col("y"))).alias("naive"))
    long = res.unpivot(["strategy"], ["strict", "wide", "naive"], "model", "roi")
    return r(e.falsification(long, "model", "strategy", "roi", "naive"), "best_roi", "naive_roi")


# ---- R ----
@query("R01_split_by_time_quantile", T("SELECT split, count(*) AS n FROM (SELECT CASE WHEN sec <= (SELECT quantile_cont(sec, 0.7) FROM t) THEN 'train' WHEN sec <= (SELECT quantile_cont(sec, 0.85) FROM t) THEN 'val' ELSE 'test' END AS split FROM t) GROUP BY 1"))
def _(t):
    return sm.split_by_time_quantile(trades(t), "sec").groupBy("split").agg(F.count("*").alias("n"))


@query("R02_split_chronological", T("SELECT trade_id, CASE WHEN (count(*) OVER (ORDER BY sec RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / (count(*) OVER ())::DOUBLE <= 0.8 THEN 'train' ELSE 'test' END AS split FROM t"))
def _(t):
    return sm.split_chronological(trades(t), "sec").select("trade_id", "split")


@query("R03_split_by_cohort", "SELECT o_orderkey, CASE WHEN c_nationkey < 10 THEN 'train' ELSE 'test' END AS split FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey < 20")
def _(t):
    c = t.customer.where("c_nationkey < 20").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_nationkey") < 10, "train").otherwise("test").alias("c"))
    return sm.split_by_cohort(t.orders, c, "o_custkey", "c").select("o_orderkey", "split")


@query("R04_group_kfold", f"SELECT event_id, floor({U('user_id', 3)} * 5)::INTEGER AS fold FROM events")
def _(t):
    return sm.group_kfold(t.events, "user_id", 5, 3).select("event_id", "fold")


@query("R05_stratified_kfold", f"SELECT event_id, ((row_number() OVER (PARTITION BY event_type ORDER BY {U('event_id', 4)}, event_id) - 1) % 5)::INTEGER AS fold FROM events")
def _(t):
    return sm.stratified_kfold(t.events, "event_type", "event_id", 5, 4).select("event_id", "fold")


@query("R06_ts_cv", T("SELECT f::INTEGER AS fold, CASE WHEN d < 10 + f * 3 THEN 'train' ELSE 'test' END AS role, count(*) AS n FROM (SELECT (sec - 1704067200) // 86400 AS d FROM t), (SELECT unnest(generate_series(0, 4)) AS f) WHERE d < 13 + f * 3 GROUP BY ALL"))
def _(t):
    d = trades(t).withColumn("d", F.floor((F.col("sec") - 1704067200) / 86400))
    return sm.ts_cv(d, "d", 10, 3, 5).groupBy("fold", "role").agg(F.count("*").alias("n"))


@query("R07_sample_n", f"SELECT event_id FROM events ORDER BY {U('event_id', 5)}, event_id LIMIT 500")
def _(t):
    return sm.sample_n(t.events, "event_id", 500, 5).select("event_id")


import math  # noqa: E402

_CDF, _tot = [], 0.0
for _i in range(9):
    _tot += math.exp(-1) / math.factorial(_i)
    _CDF.append(_tot)
W_CASE = "CASE " + " ".join(f"WHEN u < {c!r}::DOUBLE THEN {i}" for i, c in enumerate(_CDF)) + " ELSE 9 END"


def boot(src, uid, b, seed):
    m = 2147483647
    x = f"SELECT s.*, rep, (floor({U(uid, seed)} * {m})::BIGINT + rep * 1000003) % {m} * 48271 % {m} AS h FROM {src} s, (SELECT unnest(generate_series(1, {b})) AS rep)"
    x = f"SELECT * REPLACE (xor(h, h >> 15) * 69621 % {m} AS h) FROM ({x})"
    x = f"SELECT * REPLACE (xor(h, h >> 13) * 39373 % {m} AS h) FROM ({x})"
    return f"(SELECT *, {W_CASE} AS w FROM (SELECT *, h / {m}::DOUBLE AS u FROM ({x})))"


@query("R08_bootstrap_ci", PR(f"SELECT round(avg(v), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi FROM (SELECT rep, sum(y * w) / sum(w)::DOUBLE AS v FROM {boot('pr', 'id', 500, 6)} GROUP BY rep)"))
def _(t):
    return r(sm.bootstrap_ci(preds(t), "id", F.col("y"), b=500, seed=6), "mean", "lo", "hi")


@query("R09_cluster_bootstrap_ci", PR(f", c AS (SELECT taker, sum(y) AS sy, count(*) AS sn FROM pr GROUP BY 1) SELECT round(avg(v), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi FROM (SELECT rep, sum(sy * w) / sum(sn * w)::DOUBLE AS v FROM {boot('c', 'taker', 500, 7)} GROUP BY rep)"))
def _(t):
    return r(sm.cluster_bootstrap_ci(preds(t), "taker", F.col("y"), b=500, seed=7), "mean", "lo", "hi")


@query("R10_paired_bootstrap", PR(f""", v AS (SELECT rep, sum(((p - y) * (p - y) - (pm - y) * (pm - y)) * w) / sum(w)::DOUBLE AS d FROM {boot('pr', 'id', 500, 8)} GROUP BY rep)
  SELECT round(avg(d), 6) AS diff, round(quantile_cont(d, 0.025), 6) AS lo, round(quantile_cont(d, 0.975), 6) AS hi, least(1.0, 2 * least(avg((d <= 0)::INTEGER), avg((d >= 0)::INTEGER))) AS p_value,
  least(1.0, 3 * least(1.0, 2 * least(avg((d <= 0)::INTEGER), avg((d >= 0)::INTEGER)))) AS p_bonferroni FROM v"""))
def _(t):
    sq = lambda c: (F.col(c) - F.col("y")) * (F.col(c) - F.col("y"))
    return r(sm.paired_bootstrap(preds(t), "id", sq("p"), sq("pm"), 500, 8, 3), "diff", "lo", "hi")


@query("R11_random_baseline", PR(" UNION ALL ".join(f"SELECT {sd} AS seed, count(*) AS n, round(avg(y), 6) AS hit_rate FROM (SELECT * FROM pr ORDER BY {U('id', sd)}, id LIMIT 300)" for sd in (11, 12))))
def _(t):
    return r(sm.random_baseline(preds(t), "id", 300, "y", [11, 12]), "hit_rate")


@query("R12_iqr_filter", "WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS z FROM events) SELECT event_id FROM events, q WHERE value BETWEEN a - 1.5 * (z - a) AND z + 1.5 * (z - a)")
def _(t):
    return sm.iqr_filter(t.events, "value").select("event_id")
