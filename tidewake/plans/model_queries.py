"""T and X queries, and the text models N17, N19, N37 and N38."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as s, text as tx
from ..operators import aggregate as ag, cluster as cl, evaluate as ev, factor as fa, isolation, isotonic, models as m, sampling as sm, textops as n
from ..operators.nearest import lsh_topk
from ..schemas import EVENTS
from ..session import shared_dir
from ..streaming import streams as st
from .registry import query
from .series_queries import MS, monthly
from .text_queries import TF_SQL, labelled_tf, toks
from .trades import TRADES_SQL, r, trades

FEATS = ["log_chars", "word_share", "digit_share", "mark_share", "mean_word"]


def text_features(d):
    ln = F.greatest(F.length("text"), F.lit(1))
    words = F.greatest(F.size(F.split("text", r"\s+")), F.lit(1))
    return d.withColumn("text", F.coalesce("text", F.lit(""))).select(
        *[c for c in ("doc_id", "lang", "source", "quality", "toxic") if c in d.columns], F.log1p(ln).alias("log_chars"), (words / ln).alias("word_share"),
        (F.regexp_count("text", F.lit("[0-9]")) / ln).alias("digit_share"), (F.regexp_count("text", F.lit("[^A-Za-z0-9 ]")) / ln).alias("mark_share"),
        (ln / words).alias("mean_word"))


def doc_features(t):
    """All documents with five numeric features of their text; folds are dealt by a hash of the id."""
    return compact(text_features(t.documents).withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(3)).cast("int")))


def labelled_features(t):
    """The labelled documents among them, for queries whose target is a label; folds are stratified by quality."""
    return compact(sm.stratified_kfold(text_features(t.documents.join(t.labels, "doc_id")), "quality", "doc_id", 3))


def compact(df, rows_per_task=100_000):
    """Cached, in as many partitions as its rows fill; an iterative fit runs one job per step over them."""
    df = df.cache()
    return df.coalesce(max(1, -(-df.count() // rows_per_task)))


def split(t, features=doc_features):
    d = features(t)
    return d.where("fold <> 0"), d.where("fold = 0")


def L(cols):
    return ", ".join(cols)


LC = ["l_quantity", "l_discount"]


@query("T01_standard_scale", "WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_discount) AS md, stddev_pop(l_discount) AS sd FROM lineitem WHERE l_orderkey % 5 <> 0) SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - mq) / sq, 6) AS l_quantity, round((l_discount - md) / sd, 6) AS l_discount FROM lineitem, s")
def _(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", *LC)
    return r(m.standard_scale(d.where("l_orderkey % 5 <> 0"), d, LC), *LC)


@query("T02_minmax_scale", "WITH s AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS z FROM orders) SELECT o_orderkey, round((o_totalprice - a) / (z - a), 6) AS o_totalprice FROM orders, s")
def _(t):
    d = t.orders.select("o_orderkey", "o_totalprice")
    return r(m.minmax_scale(d, d, ["o_totalprice"]), "o_totalprice")


def holes(t):
    d = t.customer.join(t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.max("o_totalprice").alias("top")), "c_custkey", "left")
    return d.select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("bal"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("seg"))


HOLES = "h AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS bal, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS seg FROM customer)"


@query("T03_impute", f"WITH {HOLES}, f AS (SELECT seg FROM h WHERE seg IS NOT NULL GROUP BY seg ORDER BY count(*) DESC, seg LIMIT 1) SELECT c_custkey, round(coalesce(bal, (SELECT avg(bal) FROM h)), 6) AS bal, round(coalesce(bal, (SELECT median(bal) FROM h)), 6) AS bal_median, coalesce(h.seg, f.seg) AS seg FROM h, f")
def _(t):
    h = holes(t)
    d = h.withColumn("bal_median", F.col("bal"))
    d = m.impute(h, d, ["bal"])
    d = m.impute(h.withColumn("bal_median", F.col("bal")), d, ["bal_median"], "median")
    return r(m.impute(h, d, ["seg"], "mode"), "bal", "bal_median")


@query("T04_encode_ordinal", "SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LARGE' THEN 2 END::BIGINT AS size_code, (dense_rank() OVER (ORDER BY p_type) - 1)::BIGINT AS p_type_code FROM part")
def _(t):
    d = m.encode_ordinal(t.part, "p_type", ["SMALL", "MEDIUM", "LARGE"], "size_code")
    return m.encode_ordinal(d, "p_type").select("p_partkey", "size_code", "p_type_code")


SEGS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("T05_one_hot", f"SELECT c_custkey, {L(f'(c_mktsegment = {chr(39)}{x}{chr(39)})::INTEGER AS seg_{x}' for x in SEGS)} FROM customer")
def _(t):
    return m.one_hot(t.customer, "c_mktsegment", SEGS, "seg").select("c_custkey", *[f"seg_{x}" for x in SEGS])


@query("T06_preprocess_pipeline")
def _(t):
    h = holes(t)
    from pyspark.ml.functions import vector_to_array
    d = m.preprocess_pipeline(["bal"], ["seg"]).fit(h).transform(h)
    return d.select("c_custkey", F.transform(vector_to_array("features"), lambda x: F.round(x, 6)).alias("features"))


@query("T07_winsorise", "WITH q AS (SELECT quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS z FROM events WHERE event_id % 4 <> 0) SELECT event_id, round(least(greatest(value, a), z), 6) AS value FROM events, q")
def _(t):
    d = t.events.select("event_id", "value")
    return r(m.winsorise(d.where("event_id % 4 <> 0"), d, ["value"]), "value")


@query("T08_fit_pca")
def _(t):
    tr, te = split(t)
    _, info = m.fit_pca(tr, FEATS)
    rows = [(i + 1, e, info["elbow"], info["k90"], info["k95"]) for i, e in enumerate(info["explained"])]
    return r(t.spark.createDataFrame(rows, "component int, explained double, elbow int, k90 int, k95 int"), "explained")


@query("T09_fit_linear", "SELECT round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
def _(t):
    d = t.lineitem.select("l_quantity", "l_extendedprice")
    f = m.fit_linear(d, ["l_quantity"], "l_extendedprice").stages[-1]
    row = [(round(float(f.coefficients[0]), 3), round(float(f.intercept), 2), round(float(f.summary.r2), 6))]
    return t.spark.createDataFrame(row, "slope double, intercept double, r2 double")


@query("T10_fit_elastic")
def _(t):
    tr, te = split(t)
    cols = FEATS[:1] + FEATS[2:]
    out = []
    for name, reg, l1 in (("ridge", 0.1, 0.0), ("lasso", 0.1, 1.0), ("elastic", 0.1, 0.5)):
        f = m.fit_elastic(tr, cols, "word_share", reg * 0.01, l1)
        out += [(name, c, float(b), int(c in m.selected_features(f, cols))) for c, b in zip(cols, f.stages[-1].coefficients)]
    return t.spark.createDataFrame(out, "model string, feature string, coefficient double, selected int")


@query("T11_fit_poly")
def _(t):
    tr, te = split(t)
    f = m.fit_poly(tr, ["log_chars"], "mean_word", 3, 0.01, 0.5)
    return m.score(f, te, ["doc_id", "mean_word"])


def classifier_query(name, fit):
    @query(name)
    def _(t):
        tr, te = split(t, labelled_features)
        return m.score(fit(tr), te, ["doc_id", "quality"])


classifier_query("T12_fit_logistic", lambda d: m.fit_logistic(d, FEATS, "quality", 0.01, 0.5, True, iters=20))
classifier_query("T13_fit_tree", lambda d: m.fit_tree(d, FEATS, "quality", 5, 5))
classifier_query("T14_fit_forest", lambda d: m.fit_forest(d, FEATS, "quality", 20, 6))
classifier_query("T15_fit_gbt", lambda d: m.fit_gbt(d, FEATS, "quality", 10, 3))
classifier_query("T16_fit_pca_logistic", lambda d: m.fit_pca_logistic(d, FEATS, "quality", 3))
classifier_query("T17_fit_mlp", lambda d: m.fit_mlp(d, FEATS, "quality", (8,), 2, 30))
classifier_query("T18_fit_linear_svm", lambda d: m.fit_linear_svm(d, FEATS, "quality", iters=15))


@query("T12b_multinomial")
def _(t):
    langs = F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")])
    d = doc_features(t).withColumn("y", F.array_position(langs, F.col("lang")) - 1).where("y >= 0")
    model = m.fit_logistic(d.where("fold <> 0"), FEATS, "y", family="multinomial", iters=30)
    return m.score(model, d.where("fold = 0"), ["doc_id", "y"]).select("doc_id", "y", "prediction")


@query("T13b_tree_rules")
def _(t):
    return m.tree_rules(t.spark, m.fit_tree(split(t, labelled_features)[0], FEATS, "quality", 4, 5), FEATS)


@query("T14b_forest_importance")
def _(t):
    return r(m.importances(t.spark, m.fit_forest(split(t, labelled_features)[0], FEATS, "quality", 20, 6), FEATS), "importance")


@query("T14c_forest_regression")
def _(t):
    train, test = split(t)
    return r(m.score(m.fit_forest(train, FEATS[1:], "log_chars", 20, 6, "regression"), test, ["doc_id"]), "prediction")


@query("T18b_text_svm")
def _(t):
    d = toks(t).join(t.labels.select("doc_id", "quality"), "doc_id")
    d = sm.stratified_kfold(d, "quality", "doc_id", 3)
    return m.score(m.fit_text_svm(d.where("fold <> 0"), "tokens", "quality"), d.where("fold = 0"), ["doc_id", "quality"]).select("doc_id", "quality", "prediction")


@query("T19_kmeans_sweep")
def _(t):
    return r(cl.kmeans_sweep(doc_features(t), FEATS, [2, 3, 4]), "inertia", "silhouette")


@query("T20_kmeans_step", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT label AS c_id, arg_min(v, vec_id) AS c FROM e JOIN embeddings USING (vec_id) GROUP BY 1),
  s AS (SELECT vec_id, c_id, list_distance(v, c) AS d FROM e, c) SELECT vec_id, c_id::BIGINT AS cluster, round(d * d, 6) AS sq_dist FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c_id) = 1""")
def _(t):
    c = t.embeddings.groupBy(F.col("label").cast("bigint").alias("c_id")).agg(F.min_by("embedding", "vec_id").alias("embedding"))
    a, _ = cl.kmeans_step(t.embeddings, c, "vec_id", "c_id", "embedding")
    return r(a, "sq_dist")


@query("T20b_kmeans_means", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT label AS c_id, arg_min(v, vec_id) AS c FROM e JOIN embeddings USING (vec_id) GROUP BY 1),
  a AS (SELECT vec_id, c_id FROM (SELECT vec_id, c_id, list_distance(v, c) AS d FROM e, c) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c_id) = 1)
  SELECT c_id::BIGINT AS c_id, i::INTEGER AS i, round(avg(v[i]), 6) AS x FROM (SELECT c_id, v, unnest(generate_series(1, len(v))) AS i FROM a JOIN e USING (vec_id)) GROUP BY ALL""")
def _(t):
    c = t.embeddings.groupBy(F.col("label").cast("bigint").alias("c_id")).agg(F.min_by("embedding", "vec_id").alias("embedding"))
    _, means = cl.kmeans_step(t.embeddings, c, "vec_id", "c_id", "embedding")
    return means.select("c_id", F.posexplode("embedding").alias("i", "x")).select("c_id", (F.col("i") + 1).alias("i"), F.round("x", 6).alias("x"))


@query("T21_cluster_profile", f"""WITH {MS}, p AS (SELECT length(k)::INTEGER AS cluster, t, avg(v) AS m FROM m GROUP BY ALL) SELECT cluster, (SELECT count(DISTINCT k) FROM m WHERE length(k) = cluster) AS members, round(arg_min(p.m, t), 2) AS first_mean, round(arg_max(p.m, t), 2) AS last_mean, round((arg_max(p.m, t) / arg_min(p.m, t) - 1) * 100, 5) AS pct_change FROM p GROUP BY cluster""")
def _(t):
    d = cl.cluster_profile(monthly(t).withColumn("cluster", F.length("k")), "cluster", "k", "t", "v")
    return r(r(d, "first_mean", "last_mean", digits=2), "pct_change", digits=5)


@query("T22_dbscan")
def _(t):
    d = t.supplier.select("s_suppkey", (F.col("s_acctbal") / 1000).alias("x"), (F.col("s_nationkey") / 2).alias("y"))
    return cl.dbscan(d, "s_suppkey", ["x", "y"], 0.8, 4)


@query("T23_gmm_regimes")
def _(t):
    d = t.events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.avg("value").alias("mean_value"), F.stddev_samp("value").alias("vol")).na.fill(0.0).cache()
    return r(m.regime_stats(m.fit_gmm(d, ["mean_value", "vol"], 2), d, "mean_value", "vol").drop("prediction"), "mean", "volatility", digits=3)


KNN = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), nn AS (SELECT a.vec_id, a.label AS t, b.label, list_distance(a.v, b.v) AS d, b.vec_id AS b_id FROM e a JOIN e b ON a.vec_id % 4 = 0 AND b.vec_id % 4 <> 0),
  rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, b_id) AS rk FROM nn)"""


def knn_sides(t):
    e = t.embeddings.withColumn("b_id", F.col("vec_id"))
    return e.where("vec_id % 4 <> 0").select("b_id", "embedding", "label"), e.where("vec_id % 4 = 0").select("vec_id", "embedding", "label")


@query("T24_knn_classify", f"{KNN}, v AS (SELECT vec_id, label, count(*) AS n FROM rk WHERE rk <= 5 GROUP BY ALL) SELECT vec_id, label AS prediction FROM v QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) = 1")
def _(t):
    tr, te = knn_sides(t)
    return cl.knn_classify(tr, te, "vec_id", "b_id", "embedding", "label", 5)


@query("T24b_knn_grid", f"{KNN}, v AS (SELECT k, vec_id, t, label, count(*) AS n FROM rk, (SELECT unnest([1, 3, 5, 9]) AS k) WHERE rk <= k GROUP BY ALL), p AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY k, vec_id ORDER BY n DESC, label) = 1) SELECT k, round(avg((label = t)::INTEGER), 6) AS accuracy FROM p GROUP BY 1")
def _(t):
    tr, te = knn_sides(t)
    return r(cl.knn_grid(tr, te, "vec_id", "b_id", "embedding", "label", [1, 3, 5, 9]), "accuracy")


@query("T24c_knn_lsh", "SELECT count(*) AS n, true AS all_predicted FROM embeddings WHERE vec_id % 4 = 0")
def _(t):
    tr, te = knn_sides(t)
    d = te.select("vec_id").join(cl.knn_classify(tr, te, "vec_id", "b_id", "embedding", "label", 5, lsh_topk), "vec_id", "left")
    return d.agg(F.count("*").alias("n"), F.bool_and(F.col("prediction").isNotNull()).alias("all_predicted"))


@query("T25_iforest_score")
def _(t):
    d = t.lineitem.select((F.col("l_orderkey") * 1000000 + F.col("l_partkey")).alias("uid"), "l_quantity", "l_extendedprice", "l_discount")
    return r(isolation.iforest_score(d, "uid", ["l_quantity", "l_extendedprice", "l_discount"], F.col("uid") % 5 != 0), "anomaly")


@query("T26_zscore_flags", "WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) SELECT event_id, round((value - m) / s, 6) AS z, (abs((value - m) / s) > 3)::INTEGER AS z_flag FROM events, s")
def _(t):
    return r(cl.zscore_flags(t.events, "value").select("event_id", "z", "z_flag"), "z")


@query("T26b_detector_agreement", "WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events), f AS (SELECT (abs((value - m) / s) > 3)::INTEGER AS a, (value > 200)::INTEGER AS b FROM events, s) SELECT sum(a)::BIGINT AS n_a, sum(b)::BIGINT AS n_b, sum(a * b)::BIGINT AS n_both, round(sum(a * b) / sum(greatest(a, b))::DOUBLE, 6) AS jaccard FROM f")
def _(t):
    d = cl.zscore_flags(t.events, "value").withColumn("big", (F.col("value") > 200).cast("int"))
    return r(cl.detector_agreement(d, "z_flag", "big"), "jaccard")


RAT = "ra AS (SELECT o_custkey AS u, l_partkey AS i, avg(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"


def ratings(t):
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("u"), F.col("l_partkey").alias("i"), F.col("l_quantity").alias("v"))


@query("T27_similar_items", f"""WITH {RAT}, p AS (SELECT a.i AS i, b.i AS j, count(*) AS n, round(corr(a.v, b.v), 9) AS c, var_pop(a.v) AS va, var_pop(b.v) AS vb FROM ra a JOIN ra b ON a.u = b.u AND a.i <> b.i GROUP BY ALL HAVING count(*) >= 5)
  SELECT i, j AS similar_i, n, round(c, 6) AS corr, row_number() OVER (PARTITION BY i ORDER BY c DESC, j) AS rank FROM p WHERE va > 1e-9 AND vb > 1e-9 QUALIFY rank <= 3""")
def _(t):
    return r(cl.similar_items(ratings(t), "u", "i", "v", 5, 3), "corr").select("i", "similar_i", "n", "corr", "rank")


@query("T28_item_stats", "SELECT l_partkey AS i, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1")
def _(t):
    return r(cl.item_stats(t.lineitem.select(F.col("l_partkey").alias("i"), F.col("l_quantity").alias("v")), "i", "v"), "mean")


def oof(t):
    d = labelled_features(t)
    return m.oof_predictions(d, lambda x: m.fit_logistic(x, FEATS, "quality", 0.01, iters=15), "fold", 3, ["doc_id", "quality", "fold"])


@query("T29_isotonic_calibration")
def _(t):
    o = compact(oof(t))
    d = m.apply_isotonic(m.fit_isotonic(o, "p", "quality"), o, "p")
    return r(d.select("doc_id", "quality", "p", "p_cal"), "p", "p_cal")


PAV_SQL = """WITH d AS (SELECT round(o_totalprice / 5000)::DOUBLE AS p, (o_orderstatus = 'F')::INTEGER AS y FROM orders),
  g AS (SELECT p, sum(y)::DOUBLE AS s, count(*)::DOUBLE AS n FROM d GROUP BY 1), c AS (SELECT p, row_number() OVER w AS i, sum(s) OVER w AS cs, sum(n) OVER w AS cn, s, n FROM g WINDOW w AS (ORDER BY p)),
  a AS (SELECT i.p, j.i AS j, min((k.cs - j.cs + j.s) / (k.cn - j.cn + j.n)) AS low FROM c i JOIN c j ON j.i <= i.i JOIN c k ON k.i >= i.i GROUP BY i.p, j.i),
  f AS (SELECT p, max(low) AS v FROM a GROUP BY 1)"""


def price_scores(t):
    return t.orders.select("o_orderkey", F.round(F.col("o_totalprice") / 5000).alias("p"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))


@query("T29b_isotonic_blocks", f"{PAV_SQL} SELECT min(p) AS lo, max(p) AS hi, round(v, 9) AS value FROM f GROUP BY v")
def _(t):
    return r(isotonic.fit_isotonic(price_scores(t), "p", "y").select("lo", "hi", "value"), "value", digits=9)


@query("T29c_isotonic_scores", f"{PAV_SQL} SELECT o_orderkey, round(least(greatest(v, 1e-6), 1 - 1e-6), 6) AS p_cal FROM orders JOIN f ON round(o_totalprice / 5000) = p")
def _(t):
    d = price_scores(t)
    return r(isotonic.apply_isotonic(isotonic.fit_isotonic(d, "p", "y"), d, "p").select("o_orderkey", "p_cal"), "p_cal")


@query("T30_fit_calibrator")
def _(t):
    best, _, result = m.fit_calibrator(compact(oof(t)), "p", "quality", "fold", 3)
    return r(t.spark.createDataFrame([(k, v, int(k == best)) for k, v in result.items()], "calibrator string, ece double, chosen int"), "ece")


@query("T31_oof_stack")
def _(t):
    d = labelled_features(t)
    a = m.oof_predictions(d, lambda x: m.fit_logistic(x, FEATS, "quality", 0.01, iters=15), "fold", 3, ["doc_id", "quality"]).withColumnRenamed("p", "p_logit").drop("prediction")
    b = m.oof_predictions(d, lambda x: m.fit_forest(x, FEATS, "quality", 10, 4), "fold", 3, ["doc_id"]).withColumnRenamed("p", "p_forest").drop("prediction")
    z = compact(a.join(b, "doc_id"))
    return r(m.score(m.fit_stack(z, ["p_logit", "p_forest"], "quality"), z, ["doc_id", "quality", "p_logit", "p_forest"]), "p_logit", "p_forest", "p")


GRID = [{"reg": a, "l1": b} for a in (0.001, 0.1) for b in (0.0, 1.0)]


def search(t, rows):
    got = m.grid_search(rows, lambda x, reg, l1: m.fit_logistic(x, FEATS, "quality", reg, l1), GRID, "quality")
    setting = F.array(*[F.struct(F.lit(g["reg"]).alias("reg"), F.lit(g["l1"]).alias("l1")) for g in GRID])[F.col("setting")]
    return r(got.withColumn("_g", setting).select("_g.reg", "_g.l1", "folds", "auc"), "auc")


@query("T32_grid_search")
def _(t):
    return search(t, compact(m.cv_rows(labelled_features(t), "fold", 3)))


@query("T32b_grid_search_time")
def _(t):
    return search(t, compact(m.time_folds(labelled_features(t).drop("fold"), "doc_id", 5)))


@query("T32c_time_folds", """WITH p AS (SELECT o_orderkey, least(5, floor((rank() OVER (ORDER BY o_orderdate) - 1) / (count(*) OVER ())::DOUBLE * 6)) AS period FROM orders)
  SELECT fold::INTEGER AS fold, CASE WHEN period <= fold THEN 'train' ELSE 'test' END AS role, count(*) AS n FROM p, (SELECT unnest([0, 1, 2, 3, 4]) AS fold) WHERE period <= fold + 1 GROUP BY ALL""")
def _(t):
    d = t.orders.select("o_orderkey", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("sec"))
    return m.time_folds(d, "sec", 5).groupBy("fold", "role").agg(F.count("*").alias("n"))


@query("T33_permutation_importance")
def _(t):
    tr, te = split(t, labelled_features)
    return r(m.permutation_importance(m.fit_logistic(tr, FEATS, "quality", 0.01), te, FEATS, "quality", "doc_id"), "importance", "std")


@query("T34_group_identity_audit")
def _(t):
    tr, te = split(t)
    return r(m.group_identity_audit(tr, te, FEATS, "lang", 10, 5), "top1", "top5")


@query("T35_class_weights", "SELECT doc_id, round((SELECT count(*) FROM labels) / (2.0 * count(*) OVER (PARTITION BY quality)), 6)::DOUBLE AS weight FROM labels")
def _(t):
    return r(m.class_weights(t.labels, "quality"), "weight").select("doc_id", "weight")


# ---- text models ----
def doc_tokens(t):
    return toks(t).join(sm.stratified_kfold(t.labels, "quality", "doc_id", 3), "doc_id")


@query("N17_lda_topics")
def _(t):
    return r(m.top_words(m.lda(toks(t), "doc_id", "tokens", 4)), "weight", digits=4)


@query("N17b_lda_allocation")
def _(t):
    model = m.lda(toks(t), "doc_id", "tokens", 4, tfidf=True)
    return m.allocate(model, n.tokens_of(t.benchmark, "item_id", "text"), "item_id").select("item_id", "topic")


@query("N17c_term_ids", f"WITH {TF_SQL}, v AS (SELECT count(DISTINCT term) AS n FROM tk) SELECT n AS terms, n AS ids, (n - 1)::INTEGER AS last FROM v")
def _(t):
    return m.term_ids(toks(t), "tokens").agg(F.count_distinct("term").alias("terms"), F.count_distinct("id").alias("ids"), F.max("id").alias("last"))


@query("N19_select_k")
def _(t):
    return r(m.select_k(doc_tokens(t), "doc_id", "tokens", "quality", toks(t), "fold", range(2, 9)), "coherence", "macro_f1", digits=4)


@query("N23b_cluster_taxonomy")
def _(t):
    d = t.documents.select("doc_id", F.lit("").alias("folder"), F.lit("").alias("heading"))
    vectors = lambda _: m.cluster_taxonomy(latent(t)[1], "doc_id", "vector")
    return n.derive_taxonomy(d, ["folder", "heading"], vectors).select("doc_id", "class_label")


@query("N37_word2vec_docs")
def _(t):
    _, d = m.word2vec_docs(toks(t), "doc_id", "tokens", 16)
    return d.select("doc_id", F.size("vector").alias("dims"), F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)), 4).alias("norm"))


def latent(t):
    return fa.lsa_tokens(t.documents.select("doc_id", "text"), "doc_id", tx.tokenize("text", r"[a-z_]{2,}"), F.length("text") / 12, 8)


@query("N38_lsa")
def _(t):
    return latent(t)[1].select("doc_id", F.transform("vector", lambda x: F.round(x, 4)).alias("vector"))


@query("N38b_singular_values")
def _(t):
    values, _ = latent(t)
    return r(t.spark.createDataFrame([(i + 1, float(x)) for i, x in enumerate(values)], "component int, singular_value double"), "singular_value")


# ---- X ----
def sink(t):
    base = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex[:12]}"
    return f"{base}/out", f"{base}/ckpt"


def event_stream(t):
    return st.ingest_stream(t.spark, t.dir, EVENTS, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("X01_ingest_stream", "SELECT event_id, user_id, value FROM events")
def _(t):
    return st.run_available(event_stream(t).select("event_id", "user_id", "value"), *sink(t))


CLOSED = "<= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"


@query("X02_stream_tumbling", f"""SELECT event_type, window_start, window_start + INTERVAL 1 HOUR AS window_end, count(*) AS n, round(sum(value), 4) AS volume, round(sum(CASE WHEN event_id % 2 = 0 THEN value ELSE -value END) / sum(value), 6) AS imbalance
  FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS window_start FROM events) GROUP BY ALL HAVING window_start + INTERVAL 1 HOUR {CLOSED}""")
def _(t):
    d = event_stream(t).withColumn("signed", F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(-F.col("value")))
    g = st.stream_tumbling(d, "event_type", "ts", "1 hour", "10 minutes", "value", "signed")
    return r(r(st.run_available(g, *sink(t)), "volume", digits=4), "imbalance")


@query("X03_stream_sliding", f"""SELECT event_type, window_start, window_start + INTERVAL 1 HOUR AS window_end, count(*) AS n, round(sum(value), 4) AS volume
  FROM (SELECT event_type, value, time_bucket(INTERVAL 15 MINUTE, ts) - i * INTERVAL 15 MINUTE AS window_start FROM events, (SELECT unnest([0, 1, 2, 3]) AS i)) GROUP BY ALL HAVING window_start + INTERVAL 1 HOUR {CLOSED}""")
def _(t):
    g = st.stream_sliding(event_stream(t), "event_type", "ts", "1 hour", "15 minutes", "10 minutes", "value")
    return r(st.run_available(g, *sink(t)), "volume", digits=4)


@query("X04_stream_dedup", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def _(t):
    d = st.stream_dedup(event_stream(t).unionByName(event_stream(t)), ["user_id", "event_id", "event_type"], "ts", "31 days")
    return st.run_available(d.select("event_id", "user_id"), *sink(t)).agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


@query("X05_stream_running_state", """SELECT event_id, count(*) OVER w AS prior_count, round(coalesce(sum(value) OVER w, 0), 4) AS prior_volume, (row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1)::INTEGER AS first_seen
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(t):
    d = st.stream_running_state(event_stream(t), "user_id", "ts", "event_id", "value", "event_type")
    return r(st.run_available(d, *sink(t)), "prior_volume", digits=4).select("event_id", "prior_count", "prior_volume", "first_seen")


@query("X06_stream_enrich", "SELECT event_id, c_mktsegment FROM events LEFT JOIN customer ON user_id = c_custkey")
def _(t):
    d = st.stream_enrich(event_stream(t), t.customer.select(F.col("c_custkey").alias("user_id"), "c_mktsegment"), "user_id")
    return st.run_available(d.select("event_id", "c_mktsegment"), *sink(t))
