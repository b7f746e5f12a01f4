"""S, P, J, K, U and F queries on the star schema and on events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as s, text as tx
from ..operators import joins as j, project as p, ranking as k, sets as u
from ..operators.nearest import block_topk, lsh_topk
from ..session import shared_dir
from ..sources import readers as rd, versions as vs, writers as wr
from .registry import query
from .trades import TRADES_SQL, r, trades


def out_dir(t, name):
    import uuid

    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex[:12]}"


# ---- S ----
@query("S01_scan_parquet", "SELECT o_orderkey, o_totalprice FROM orders")
def _(t):
    return rd.scan_parquet(t.spark, f"{t.dir}/orders.parquet", ["o_orderkey", "o_totalprice"])


@query("S02_scan_trades", """SELECT l_orderkey, l_suppkey, l_quantity FROM lineitem WHERE l_orderkey >= 1000 AND l_orderkey < 5000
  AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)""")
def _(t):
    ids = t.supplier.where("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    return rd.scan_trades(t.spark, f"{t.dir}/lineitem.parquet", ids, "l_suppkey", "l_orderkey", 1000, 5000,
                          ["l_orderkey", "l_suppkey", "l_quantity"])


@query("S03_filter_in", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(t):
    return rd.filter_in(t.orders, "o_custkey", t.customer.where("c_mktsegment = 'BUILDING'"), "c_custkey").select("o_orderkey")


@query("S04_scan_csv_semicolon", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer")
def _(t):
    path = out_dir(t, "csv")
    t.customer.selectExpr("c_custkey AS nummer", "c_name AS navn", "c_acctbal AS saldo").write.option("sep", ";").option(
        "header", True).csv(path)
    return rd.scan_csv(t.spark, path, "nummer bigint, navn string, saldo double", ";",
                       rename={"nummer": "id", "navn": "name", "saldo": "balance"})


@query("S05_scan_tsv", "SELECT item_id, length(text) AS n FROM benchmark")
def _(t):
    path = out_dir(t, "tsv")
    t.benchmark.write.option("sep", "\t").option("escape", '"').csv(path)
    d = rd.scan_csv(t.spark, path, "item_id bigint, text string", "\t", header=False, multiline=True)
    return d.select("item_id", F.length("text").cast("bigint").alias("n"))


@query("S06_scan_csv_dir", "SELECT count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer")
def _(t):
    path = out_dir(t, "csvdir")
    t.customer.select("c_custkey", "c_acctbal").repartition(4, "c_custkey").write.csv(path)
    d = rd.scan_csv_dir(t.spark, path, "c_custkey bigint, c_acctbal double", "*.csv", header=False)
    return d.agg(F.count("source_file").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("S07_scan_json", "SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events")
def _(t):
    path = out_dir(t, "json")
    t.events.select("event_id", F.from_json("props", "k int").alias("props")).write.json(path)
    return rd.scan_json(t.spark, path, "event_id bigint, props struct<k:int>").select("event_id", "props.k")


@query("S08_document_columns", """SELECT substr(sha1(lang || '/' || doc_id || '.md'), 1, 12) AS doc_id,
  lang || '/' || doc_id || '.md' AS relative_path, lang AS folder_label, doc_id || '.md' AS filename, NULL::VARCHAR AS top_heading,
  false AS is_metadata, text FROM documents""")
def _(t):
    d = t.documents.select(F.concat(F.lit("/kb/"), "lang", F.lit("/"), "doc_id", F.lit(".md")).alias("path"), "text")
    return rd.document_columns(d, "path", "/kb", "text")


@query("S08b_scan_documents", "SELECT item_id, md5(text) AS h FROM benchmark")
def _(t):
    path = out_dir(t, "kb")
    t.benchmark.select("item_id", "text").write.partitionBy("item_id").text(path)
    d = rd.scan_documents(t.spark, path, "txt")
    return d.select(F.regexp_extract("folder_label", r"item_id=(\d+)", 1).cast("bigint").alias("item_id"), F.md5(F.regexp_replace("text", r"\n$", "")).alias("h"))


@query("S09_scan_sheets", "SELECT 'nation' AS sheet, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def _(t):
    a, b = out_dir(t, "sheet"), out_dir(t, "sheet")
    t.nation.write.csv(a)
    t.region.write.csv(b)
    x = rd.scan_csv(t.spark, a, "n_nationkey int, n_name string, n_regionkey int", header=False)
    y = rd.scan_csv(t.spark, b, "r_regionkey int, r_name string", header=False)
    return u.union_sources(x.agg(F.lit("nation").alias("sheet"), F.count("*").alias("n")),
                           y.agg(F.lit("region").alias("sheet"), F.count("*").alias("n")))


@query("S10_sink_parquet", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def _(t):
    path = wr.sink_parquet(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), out_dir(t, "pq"), "o_orderstatus")
    d = rd.scan_parquet(t.spark, path)
    return d.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("S10b_replace_table", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice) * 2, 2) AS total FROM orders GROUP BY 1")
def _(t):
    path = out_dir(t, "table")
    vs.replace_table(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), path)
    old = vs.read_table(t.spark, path)
    vs.replace_table(old.withColumn("o_totalprice", F.col("o_totalprice") * 2), path)  # of its own rows
    vs.stage(old.limit(1), path)  # a job that died before it published
    d = vs.read_table(t.spark, path)
    return d.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("S11_sink_bucketed", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS keys FROM orders")
def _(t):
    path = wr.sink_bucketed(t.orders.select("o_orderkey", "o_custkey"), out_dir(t, "bk"), "o_custkey", 8)
    d = rd.scan_parquet(t.spark, path)
    return d.agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("keys"))


@query("S12_sink_report", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    path = wr.sink_report(t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n")), out_dir(t, "rep"), "json")
    return rd.scan_json(t.spark, path, "l_returnflag string, n bigint")


@query("S13_scan_shards", "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS key_sum FROM orders")
def _(t):
    base = out_dir(t, "shards")
    for i in range(3):
        wr.sink_parquet(t.orders.where(F.pmod("o_orderkey", F.lit(3)) == i).select("o_orderkey", "o_custkey"), f"{base}/shard{i}")
    d = rd.scan_parquet(t.spark, [f"{base}/shard{i}" for i in range(3)])
    return d.agg(F.count("*").alias("n"), F.sum("o_custkey").alias("key_sum"))


@query("S13b_new_shards", "SELECT 2 AS first, 1 AS second, 0 AS third, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS key_sum FROM orders")
def _(t):
    base, out = out_dir(t, "arriving"), out_dir(t, "covered")
    taken = []
    for shards in ([0, 1], [2], []):
        for i in shards:
            wr.sink_parquet(t.orders.where(F.pmod("o_orderkey", F.lit(3)) == i).select("o_orderkey", "o_custkey").coalesce(1), f"{base}/shard{i}")
        vs.stage_new_shards(t.spark, base, out)  # a run that died before it published
        taken.append(vs.take_new_shards(t.spark, base, out))
    d = vs.read_shards(t.spark, out).agg(F.count("*").alias("n"), F.sum("o_custkey").alias("key_sum"))
    return d.select(*[F.lit(x).alias(c) for x, c in zip(taken, ("first", "second", "third"))], "n", "key_sum")


# ---- P ----
@query("P01_to_canonical_trades", """SELECT CAST(event_id AS VARCHAR) AS trade_id, CAST(floor(epoch(ts)) AS BIGINT) AS timestamp,
  upper(event_type) AS direction, value AS usd_amount, to_timestamp(floor(epoch(ts)))::TIMESTAMP AS ts_dt FROM events""")
def _(t):
    d = t.events.withColumn("epoch", F.unix_timestamp("ts"))
    return p.to_canonical_trades(d, {"trade_id": "event_id", "timestamp": "epoch", "direction": "event_type", "usd_amount": "value"})


@query("P02_map_outcome", """SELECT event_id, CAST(event_id % 2 AS INTEGER) AS outcome_index,
  CASE WHEN event_id % 2 = 0 THEN 'A' || event_type ELSE 'B' || event_type END AS token_id FROM events""")
def _(t):
    d = t.events.select("event_id", "event_type", F.when(F.col("event_id") % 2 == 0, "token1").otherwise("token2").alias("side"))
    m = t.events.groupBy("event_type").agg(F.first(F.concat(F.lit("A"), "event_type", F.lit(";B"), "event_type")).alias("tokens"))
    return p.map_outcome(d, m, "event_type", "side", "tokens").select("event_id", "outcome_index", "token_id")


@query("P03_filter_regex", "SELECT p_partkey FROM part WHERE regexp_full_match(p_name, '(?i)red \\w+')")
def _(t):
    return p.filter_regex(t.part, "p_name", r"RED \w+").select("p_partkey")


@query("P04_filter_keyword_groups", r"""SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '\b(?:the|that)\b')
  AND regexp_matches(lower(text), '\b(?:and|or)\b') AND regexp_matches(lower(text), 'tion')""")
def _(t):
    return p.filter_keyword_groups(t.documents, "text", [r"\b(?:the|that)\b", r"\b(?:and|or)\b", "tion"]).select("doc_id")


@query("P05_classify_rules", """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(lower(p_name), '^red') THEN 'warm'
  WHEN regexp_matches(lower(p_name), 'blue|green') THEN 'cold' WHEN regexp_matches(lower(p_name), 'ring$') THEN 'ring'
  ELSE 'review' END AS reason FROM part) GROUP BY reason""")
def _(t):
    d = p.classify_rules(t.part, "p_name", [("^red", "warm"), ("blue|green", "cold"), ("ring$", "ring")], "review")
    return d.groupBy("reason").agg(F.count("*").alias("n"))


CAT_CASE = " ".join(
    "WHEN " + " OR ".join(f"contains(x, '{w}')" for w in words) + f" THEN '{lab}'" for lab, words in p.CATEGORIES)


@query("P06_bucket_category", f"SELECT category, count(*) AS n FROM (SELECT CASE {CAT_CASE} ELSE 'other' END AS category FROM (SELECT lower(text) AS x FROM documents)) GROUP BY category")
def _(t):
    return p.bucket_category(t.documents, "text").groupBy("category").agg(F.count("*").alias("n"))


@query("P07_having_min_rows", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 70")
def _(t):
    return p.having_min_rows(t.events, "user_id", 70, 50).groupBy("user_id").agg(F.count("*").alias("n"))


@query("P08_filter_post_event", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE epoch(l_shipdate) - epoch(o_orderdate) < 86400 * 30")
def _(t):
    d = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumns(
        {"sec": F.unix_timestamp("l_shipdate"), "settle": F.unix_timestamp("o_orderdate") + 86400 * 30})
    return p.filter_post_event(d, "sec", "settle").select("l_orderkey", "l_linenumber", "l_partkey")


@query("P09_drop_tiers", "SELECT p_partkey, p_name, p_size FROM part")
def _(t):
    return p.drop_tiers(t.part, {"price": ["p_retailprice", "p_cost"], "kind": ["p_type", "p_brand"]})[0]


@query("P10_feature_cols", "SELECT avg(l_discount) AS l_discount, avg(l_quantity) AS l_quantity, avg(l_tax) AS l_tax FROM (SELECT round(l_discount, 2) AS l_discount, l_quantity, l_tax FROM lineitem)"
       .replace("avg(l_discount)", "round(avg(l_discount), 6)").replace("avg(l_quantity)", "round(avg(l_quantity), 6)").replace("avg(l_tax)", "round(avg(l_tax), 6)"))
def _(t):
    cols = p.feature_cols(t.lineitem, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_linestatus", "l_shipdate"],
                          "l_returnflag", ["l_extendedprice"])
    return t.lineitem.agg(*[F.round(F.avg(c), 6).alias(c) for c in cols])


@query("P11_clip", "SELECT event_id, least(greatest(value, 1.0), 100.0) AS v FROM events")
def _(t):
    return t.events.select("event_id", s.clip("value", 1.0, 100.0).alias("v"))


@query("P12_finite_or_zero", "SELECT event_id, CASE WHEN event_id % 5 IN (0, 1, 2, 3) THEN 0.0 ELSE value END AS v FROM events")
def _(t):
    m = F.col("event_id") % 5
    v = F.when(m == 0, F.lit(float("nan"))).when(m == 1, F.lit(float("inf"))).when(m == 2, F.lit(float("-inf"))).when(m == 4, F.col("value"))
    return p.finite_or_zero(t.events.select("event_id", v.alias("v")), ["v"])


@query("P13_missing_flags", "SELECT c_custkey, CAST(c_acctbal > 0 AS INTEGER) AS has_balance, CAST(n IS NOT NULL AS INTEGER) AS has_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def _(t):
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    d = p.missing_flags(t.customer.join(n, "c_custkey", "left"), {"has_balance": "c_acctbal"}, {"has_orders": "n"})
    return d.select("c_custkey", "has_balance", "has_orders")


@query("P14_feature_taxonomy", """SELECT CASE WHEN column_name LIKE '%key' THEN 'key' WHEN column_name LIKE '%price' OR column_name LIKE '%discount%' THEN 'money'
  ELSE 'other' END AS grp, count(*) AS n FROM (DESCRIBE lineitem) GROUP BY 1""")
def _(t):
    return p.feature_taxonomy(t.lineitem, [("key$", "key"), ("price$|discount", "money")])


@query("P15_between_dates", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-06-30'")
def _(t):
    return p.between_dates(t.orders, "o_orderdate", "1997-01-01", "1997-06-30").select("o_orderkey")


@query("P16_filter_group_max", "SELECT p_brand, p_partkey FROM part QUALIFY p_size = max(p_size) OVER (PARTITION BY p_brand)")
def _(t):
    return p.filter_group_max(t.part, "p_brand", "p_size").select("p_brand", "p_partkey")


# ---- J ----
@query("J01_join_dim", "SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def _(t):
    d = j.join_dim(t.supplier.withColumnRenamed("s_nationkey", "n_nationkey"), t.nation, "n_nationkey")
    return j.join_dim(d.withColumnRenamed("n_regionkey", "r_regionkey"), t.region, "r_regionkey").select("s_suppkey", "n_name", "r_name")


@query("J02_align_inner", """WITH a AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1),
  b AS (SELECT CAST(l_shipdate AS DATE) AS d, count(*) AS m FROM lineitem GROUP BY 1) SELECT d, n, m FROM a JOIN b USING (d)""")
def _(t):
    a = t.orders.groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("n"))
    b = t.lineitem.groupBy(F.to_date("l_shipdate").alias("d")).agg(F.count("*").alias("m"))
    return j.align_inner(a, b, "d", ["n", "m"])


@query("J03_join_point_features", f"""WITH {TRADES_SQL}, f AS (SELECT taker, market, price AS f_price FROM t
  QUALIFY row_number() OVER (PARTITION BY taker, market ORDER BY ts, trade_id) = 1) SELECT trade_id, f_price FROM t LEFT JOIN f USING (taker, market)""")
def _(t):
    d = trades(t)
    f = d.select("taker", "market", "ts", "trade_id", F.col("price").alias("f_price")).withColumnRenamed("trade_id", "f_id")
    return j.join_point_features(d.drop("ts"), f, ["taker", "market"], ["ts", "f_id"]).select("trade_id", "f_price")


@query("J04_join_first_per_key", """WITH f AS (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1)
  SELECT c_custkey, o_orderkey FROM customer LEFT JOIN f ON c_custkey = o_custkey""")
def _(t):
    dim = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey")
    return j.join_first_per_key(t.customer, dim, "c_custkey", ["o_orderdate", "o_orderkey"]).select("c_custkey", "o_orderkey")


@query("J05_asof_backward", f"""WITH {TRADES_SQL} SELECT trade_id, coalesce((SELECT arg_max(b.price, (b.sec, b.trade_id)) FROM t b
  WHERE b.market = 'view' AND b.taker = a.taker AND b.sec < a.sec), a.price) AS quote FROM t a WHERE a.market = 'click'""")
def _(t):
    d = trades(t)
    return j.asof_backward(d.where("market = 'click'"), d.where("market = 'view'"), "taker", "sec", "price",
                           "trade_id", "quote", fallback=F.col("price")).select("trade_id", "quote")


PIT = """WITH h AS (SELECT o_custkey, list(epoch(o_orderdate)::BIGINT ORDER BY o_orderdate, o_orderkey) AS ts,
  list(o_totalprice ORDER BY o_orderdate, o_orderkey) AS am FROM orders GROUP BY 1)"""


@query("J06_pit_array_features", f"""{PIT} SELECT o_orderkey, CAST(len(list_filter(ts, lambda x: x < epoch(o_orderdate)::BIGINT)) AS BIGINT) AS pit_count,
  round(coalesce(list_sum(am[1:len(list_filter(ts, lambda x: x < epoch(o_orderdate)::BIGINT))]), 0), 2) AS pit_amount,
  epoch(o_orderdate)::BIGINT - ts[1] AS pit_age, round((epoch(o_orderdate)::BIGINT - ts[1]) / 86400.0, 6) AS pit_days FROM orders JOIN h USING (o_custkey)""")
def _(t):
    o = t.orders.withColumn("sec", F.unix_timestamp("o_orderdate"))
    h = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("sec", "o_orderkey", "o_totalprice"))).alias("h"))
    h = h.select("o_custkey", F.col("h.sec").alias("times"), F.col("h.o_totalprice").alias("amounts"))
    d = j.pit_array_features(o.join(h, "o_custkey"), "sec", "times", "amounts")
    return r(r(d, "pit_amount", digits=2), "pit_days").select("o_orderkey", "pit_count", "pit_amount", "pit_age", "pit_days")


@query("J06b_pit_event_features", """SELECT a.o_orderkey, count(b.o_orderkey) AS pit_count, round(coalesce(sum(b.o_totalprice), 0), 2) AS pit_amount,
  epoch(any_value(a.o_orderdate))::BIGINT - epoch(min(b.o_orderdate))::BIGINT AS pit_age
  FROM orders a LEFT JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate < a.o_orderdate GROUP BY 1""")
def _(t):
    o = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", F.unix_timestamp("o_orderdate").alias("sec"))
    d = j.pit_event_features(o, o, "o_custkey", "sec", "o_totalprice")
    return r(d, "pit_amount", digits=2).select("o_orderkey", "pit_count", "pit_amount", "pit_age")


@query("J07_flag_in", "SELECT c_custkey, CAST(c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01') AS INTEGER) AS seen FROM customer")
def _(t):
    seen = t.orders.where("o_orderdate < timestamp_ntz'1995-06-01'").select(F.col("o_custkey").alias("c_custkey"))
    return j.flag_in(t.customer, seen, "c_custkey").select("c_custkey", "seen")


@query("J08_orphans", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return j.orphans(t.documents, t.labels, "doc_id").select("doc_id")


@query("J09_range_join", f"""WITH {TRADES_SQL}, i AS (SELECT taker, trade_id AS i_id, sec AS lo, sec + 7200 AS hi FROM t WHERE market = 'purchase')
  SELECT t.trade_id, i.i_id FROM t JOIN i ON t.taker = i.taker AND t.sec >= i.lo AND t.sec < i.hi""")
def _(t):
    d = trades(t)
    i = d.where("market = 'purchase'").select("taker", F.col("trade_id").alias("i_id"), F.col("sec").alias("lo"), (F.col("sec") + 7200).alias("hi"))
    return j.range_join(d.select("taker", "trade_id", "sec"), i, "taker", "sec", "lo", "hi", 7200).select("trade_id", "i_id")


@query("J10_param_grid", """SELECT a.n AS segments, w.pct, count(*) FILTER (o_totalprice > w.pct * 500000) AS n FROM (VALUES (1), (2)) a(n),
  (VALUES (0.1::DOUBLE), (0.5)) w(pct), orders GROUP BY ALL""".replace("(VALUES (1), (2)) a(n)", "(SELECT unnest([1::BIGINT, 2::BIGINT]) AS n) a"))
def _(t):
    g = j.param_grid(t.spark, segments=[1, 2], pct=[0.1, 0.5])
    arr = F.array(*[F.struct(F.lit(a).cast("bigint").alias("segments"), F.lit(b).alias("pct")) for a, b in [(x.segments, x.pct) for x in g.collect()]])
    d = t.orders.select("o_totalprice", F.explode(arr).alias("g")).select("o_totalprice", "g.*")
    return d.groupBy("segments", "pct").agg(F.sum((F.col("o_totalprice") > F.col("pct") * 500000).cast("bigint")).alias("n"))


@query("J11_compare_runs", """WITH b AS (SELECT c_custkey AS id, c_mktsegment AS l FROM customer WHERE c_custkey % 10 <> 0),
  a AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'MACHINERY' ELSE c_mktsegment END AS l FROM customer WHERE c_custkey % 11 <> 0)
  SELECT b.l AS "before", a.l AS "after", count(*) AS n, coalesce(b.l, '(none)') || ' -> ' || coalesce(a.l, '(none)') AS transition
  FROM b FULL JOIN a USING (id) GROUP BY ALL""")
def _(t):
    b = t.customer.where("c_custkey % 10 <> 0").selectExpr("c_custkey AS id", "c_mktsegment AS l")
    a = t.customer.where("c_custkey % 11 <> 0").selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 3 = 0 THEN 'MACHINERY' ELSE c_mktsegment END AS l")
    return j.compare_runs(b, a, "id", "l")


@query("J12_pairs", """WITH s AS (SELECT n_name AS k, round(avg(s_acctbal), 4) AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
  SELECT a.k AS k_a, b.k AS k_b, round(abs(a.v - b.v), 3) AS d FROM s a JOIN s b ON a.k < b.k""")
def _(t):
    sdf = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("k")).agg(F.round(F.avg("s_acctbal"), 4).alias("v"))
    return j.pairs(sdf, "k").select("k_a", "k_b", F.round(F.abs(F.col("v_a") - F.col("v_b")), 3).alias("d"))


@query("J13_cosine_join", """SELECT q_id, vec_id, round(s, 6) AS score, rank FROM (SELECT q_id, vec_id, s, row_number() OVER (PARTITION BY q_id ORDER BY s DESC, vec_id) AS rank
  FROM (SELECT a.vec_id AS q_id, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id)) WHERE rank <= 5""")
def _(t):
    q = t.embeddings.select(F.col("vec_id").alias("q_id"), "embedding")
    d = block_topk(q, t.embeddings, "q_id", "vec_id", "embedding", 5, exclude_self=True)
    return r(d, "score").select("q_id", "vec_id", "score", "rank")


@query("J13b_lsh_join")
def _(t):
    q = t.embeddings.select(F.col("vec_id").alias("q_id"), "embedding")
    return r(lsh_topk(q, t.embeddings, "q_id", "vec_id", "embedding", 5, exclude_self=True), "score").select("q_id", "vec_id", "score", "rank")


@query("J13c_lsh_recall", "SELECT count(*) AS queries, true AS recall_90 FROM embeddings")
def _(t):
    q = t.embeddings.select(F.col("vec_id").alias("q_id"), "embedding")
    exact, found = [f(q, t.embeddings, "q_id", "vec_id", "embedding", 5, exclude_self=True).select("q_id", "vec_id") for f in (block_topk, lsh_topk)]
    per = exact.join(found.withColumn("hit", F.lit(1)), ["q_id", "vec_id"], "left").groupBy("q_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("share"))
    return per.agg(F.count("*").alias("queries"), (F.avg("share") >= 0.9).alias("recall_90"))


# ---- K ----
@query("K01_top_fraction", "SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) <= greatest(1, floor(count(*) OVER () * 0.01))")
def _(t):
    return k.top_fraction(t.orders, "o_totalprice", 0.01, "o_orderkey").select("o_orderkey")


@query("K02_top_groups", "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 10")
def _(t):
    return r(k.top_groups(t.orders, "o_custkey", "o_totalprice", 10), "total", digits=2)


@query("K03_topk_by", "SELECT c_nationkey, c_custkey, rank FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 3")
def _(t):
    return k.topk_by(t.customer, "c_nationkey", "c_acctbal", "c_custkey", 3).select("c_nationkey", "c_custkey", "rank")


@query("K04_stable_sort", "SELECT c_mktsegment, c_nationkey, c_custkey FROM customer ORDER BY ALL")
def _(t):
    return k.stable_sort(t.customer, "c_mktsegment", "c_nationkey", unique="c_custkey").select("c_mktsegment", "c_nationkey", "c_custkey")


@query("K05_first_per_group", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def _(t):
    return k.first_per_group(t.events, "user_id", ["ts", "event_id"]).select("user_id", "event_id")


H = "('0x' || substr(md5({}), 1, 12))::BIGINT / 281474976710656.0::DOUBLE"


@query("K06_cap_per_group", f"SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {H.format('event_id || chr(58) || 7')}, event_id) <= 20")
def _(t):
    return k.cap_per_group(t.events, "user_id", "event_id", 20, seed=7).select("user_id", "event_id")


@query("K06b_stride_per_group", f"WITH {TRADES_SQL} SELECT trade_id FROM t QUALIFY (row_number() OVER (PARTITION BY market ORDER BY ts, trade_id) - 1) % 10 = 0")
def _(t):
    return k.stride_per_group(trades(t), "market", "sec", ("ts", "trade_id"), 10).select("trade_id")


# ---- U ----
@query("U01_union_sources", "SELECT c_custkey AS id, c_nationkey AS nationkey, c_acctbal AS bal, c_mktsegment AS seg FROM customer UNION ALL SELECT s_suppkey, s_nationkey, s_acctbal, NULL FROM supplier")
def _(t):
    a = t.customer.selectExpr("c_custkey AS id", "c_nationkey AS nationkey", "c_acctbal AS bal", "c_mktsegment AS seg")
    return u.union_sources(a, t.supplier.selectExpr("s_suppkey AS id", "s_acctbal AS bal", "s_nationkey AS nationkey"))


@query("U02_dedup", "SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem) QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1")
def _(t):
    return u.dedup(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


@query("U03_cohort_overlap", """WITH a AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'), b AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1996-06-01')
  SELECT (SELECT count(DISTINCT o_custkey) FROM a) AS keys_a, (SELECT count(DISTINCT o_custkey) FROM b) AS keys_b,
  (SELECT count(*) FROM (SELECT o_custkey FROM a INTERSECT SELECT o_custkey FROM b)) AS common, 1::INTEGER AS time_overlap""")
def _(t):
    return u.cohort_overlap(t.orders.where("o_orderdate < timestamp_ntz'1997-01-01'"), t.orders.where("o_orderdate >= timestamp_ntz'1996-06-01'"), "o_custkey", "o_orderdate")


@query("U04_except_keys", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    return u.except_keys(t.customer.select("c_custkey"), t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("U05_jaccard_pairs", """WITH m AS (SELECT DISTINCT p_brand AS k, l_suppkey AS m FROM lineitem JOIN part ON l_partkey = p_partkey), n AS (SELECT k, count(*) AS n FROM m GROUP BY k),
  c AS (SELECT x.k AS a, y.k AS b, count(*) AS c FROM m x JOIN m y ON x.m = y.m AND x.k < y.k GROUP BY ALL)
  SELECT a, b, c AS common, round(c / CAST(x.n + y.n - c AS DOUBLE), 6) AS jaccard FROM c JOIN n x ON c.a = x.k JOIN n y ON c.b = y.k""")
def _(t):
    m = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("k"), F.col("l_suppkey").alias("m"))
    return r(u.jaccard_pairs(m, "k", "m"), "jaccard")


@query("U06_topset_overlap", """WITH a AS (SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) <= floor(count(*) OVER () * 0.1)),
  b AS (SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY o_custkey DESC, o_orderkey) <= floor(count(*) OVER () * 0.1))
  SELECT (SELECT count(*) FROM a JOIN b USING (o_orderkey)) AS overlap, (SELECT count(*) FROM a) AS k,
  round((SELECT count(*) FROM a) * (SELECT count(*) FROM a) / (SELECT count(*) FROM orders)::DOUBLE, 6) AS expected""")
def _(t):
    return r(u.topset_overlap(t.orders, "o_totalprice", "o_custkey", 0.1, "o_orderkey"), "expected")
