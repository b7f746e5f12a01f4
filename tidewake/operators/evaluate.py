"""E: ranking, probability and regression metrics, all groupable."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.scalars import bin_edges
from .joins import flag_in
from .ordering import bucket_of, cut_points, quantiles
from .ranking import top_fraction


def _keys(k) -> list[str]:
    return [] if k is None else [k] if isinstance(k, str) else list(k)


def _over(by, order=None):
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return w.orderBy(order) if order is not None else w


def _score_buckets(df, y, p, by, cuts=None):
    """(by, score) counts of positives and negatives with the score's bucket."""
    d = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    cuts = cut_points(d, p) if cuts is None else cuts
    g = d.groupBy(*by, F.col(p).alias("_p")).agg(
        F.sum(F.col(y).cast("double")).alias("_pos"), F.sum(1 - F.col(y).cast("double")).alias("_neg"))
    return g.withColumn("_b", bucket_of(F.col("_p"), cuts))


def auc(df, y, p, by=None, cuts=None) -> DataFrame:
    """Area under the ROC curve, ties counted half; null when a group has one class.

    Pairs are counted on distinct scores inside score buckets; a bucket then needs only the number
    of negatives below it.
    """
    by = _keys(by)
    g = _score_buckets(df, y, p, by, cuts)
    w = Window.partitionBy(*by, "_b").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("_below", F.coalesce(F.sum("_neg").over(w), F.lit(0.0)))
    b = g.groupBy(*by, "_b").agg(
        F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2)).alias("_in"),
        F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"))
    wb = _over(by, F.col("_b")).rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    b = b.withColumn("_low", F.coalesce(F.sum("_neg").over(wb), F.lit(0.0)))
    pos, neg = F.sum("_pos"), F.sum("_neg")
    return b.groupBy(*by).agg(
        F.when((pos > 0) & (neg > 0), F.sum(F.col("_in") + F.col("_pos") * F.col("_low")) / (pos * neg)).alias("auc"),
        (pos + neg).cast("bigint").alias("n"),
    )


def brier(df, y, p, by=None) -> DataFrame:
    """Brier score, base rate and size."""
    e = F.col(p) - F.col(y)
    return df.groupBy(*_keys(by)).agg(F.avg(e * e).alias("brier"), F.avg(y).alias("base_rate"), F.count(y).alias("n"))


def _bin(p, n_bins) -> Column:
    return F.least(F.floor(F.col(p) * n_bins), F.lit(n_bins - 1)).cast("int")


def reliability(df, y, p, n_bins=10, by=None) -> DataFrame:
    """Mean score, observed rate and size per equal-width bin."""
    return df.groupBy(*_keys(by), _bin(p, n_bins).alias("bin")).agg(
        F.avg(p).alias("mean_p"), F.avg(y).alias("rate"), F.count(y).alias("n"))


def ece(df, y, p, n_bins=10, by=None) -> DataFrame:
    """Expected calibration error; a score of 1 belongs to the last bin."""
    r = reliability(df, y, p, n_bins, by)
    return r.groupBy(*_keys(by)).agg(
        (F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))


def confusion(df, y, yhat) -> DataFrame:
    """Counts per (actual, predicted)."""
    return df.groupBy(F.col(y).alias("actual"), F.col(yhat).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def classification_report(df, y, yhat) -> DataFrame:
    """Precision, recall, F1 and support per class, plus accuracy, macro and weighted rows."""
    c = confusion(df, y, yhat)
    cell = F.array(
        F.struct(F.col("actual").cast("string").alias("label"), F.col("n").alias("s"), F.lit(0).cast("bigint").alias("g"),
                 F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("h")),
        F.struct(F.col("predicted").cast("string").alias("label"), F.lit(0).cast("bigint").alias("s"),
                 F.col("n").alias("g"), F.lit(0).cast("bigint").alias("h")),
    )
    k = c.select(F.explode(cell).alias("x")).select("x.*").groupBy("label").agg(
        F.sum("s").alias("support"), F.sum("g").alias("_g"), F.sum("h").alias("_h"))
    pr = F.when(F.col("_g") > 0, F.col("_h") / F.col("_g")).otherwise(0.0)
    rc = F.when(F.col("support") > 0, F.col("_h") / F.col("support")).otherwise(0.0)
    k = k.withColumns({"precision": pr, "recall": rc})
    k = k.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                  2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))
    cols = ["precision", "recall", "f1"]
    per = k.select("label", *cols, "support")
    macro = k.agg(*[F.avg(x).alias(x) for x in cols], F.sum("support").alias("support")).withColumn("label", F.lit("macro avg"))
    wavg = k.agg(*[(F.sum(F.col(x) * F.col("support")) / F.sum("support")).alias(x) for x in cols],
                 F.sum("support").alias("support")).withColumn("label", F.lit("weighted avg"))
    acc = k.agg((F.sum("_h") / F.sum("support")).alias("a"), F.sum("support").alias("support")).select(
        F.lit("accuracy").alias("label"), *[F.col("a").alias(x) for x in cols], "support")
    return per.unionByName(acc).unionByName(macro).unionByName(wavg)


def average_precision(df, y, p, by=None, cuts=None) -> DataFrame:
    """Average precision over descending scores, ties taken together."""
    by = _keys(by)
    g = _score_buckets(df, y, p, by, cuts)
    b = g.groupBy(*by, "_b").agg(F.sum("_pos").alias("_bp"), F.sum(F.col("_pos") + F.col("_neg")).alias("_bn"))
    wb = _over(by, F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    b = b.select(*[F.col(k).alias(f"_k_{k}") for k in by], F.col("_b").alias("_kb"),
                 F.coalesce(F.sum("_bp").over(wb), F.lit(0.0)).alias("_cp"),
                 F.coalesce(F.sum("_bn").over(wb), F.lit(0.0)).alias("_cn"))
    on = reduce(lambda x, z: x & z, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by], F.col("_b") == F.col("_kb"))
    w = Window.partitionBy(*by, "_b").orderBy(F.col("_p").desc()).rowsBetween(Window.unboundedPreceding, 0)
    j = g.join(b, on)
    tp = F.col("_cp") + F.sum("_pos").over(w)
    n = F.col("_cn") + F.sum(F.col("_pos") + F.col("_neg")).over(w)
    j = j.withColumn("_t", F.col("_pos") * tp / n)
    return j.groupBy(*by).agg(F.when(F.sum("_pos") > 0, F.sum("_t") / F.sum("_pos")).alias("ap"))


def regression_errors(df, y, yhat, by=None, scale: Column | None = None) -> DataFrame:
    """RMSE, MAE, MAPE, R2 and, given the in-sample naive MAE as ``scale``, MASE."""
    e = F.col(y) - F.col(yhat)
    sse, sst = F.sum(e * e), F.var_pop(y) * F.count(y)
    g = df.groupBy(*_keys(by)).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        (F.avg(F.when(F.col(y) != 0, F.abs(e / F.col(y)))) * 100).alias("mape"),
        F.when(sst > 0, 1 - sse / sst).alias("r2"),
        *([F.avg(F.abs(e) / scale).alias("mase")] if scale is not None else []),
    )
    return g


def metrics_by(df, y, p, key, min_n=1) -> DataFrame:
    """AUC, base rate and mean score per group of at least ``min_n`` rows."""
    keys = _keys(key)
    g = df.groupBy(*keys).agg(F.avg(y).alias("base_rate"), F.avg(p).alias("mean_p"))
    return auc(df, y, p, keys).join(g, keys).where(F.col("n") >= min_n)


def feature_stability(df, cols, y, key) -> DataFrame:
    """AUC of every single feature per group, summarised over groups."""
    per = [auc(df.select(F.col(key).alias("_g"), F.col(y).alias("_y"), F.col(c).cast("double").alias("_x")), "_y", "_x", "_g")
           .select(F.lit(c).alias("feature"), "auc") for c in cols]
    a = reduce(DataFrame.unionByName, per)
    # one AUC per group: quantiles over groups
    q = quantiles(a, "auc", [0.05, 0.5, 0.95], "feature", ["p05", "median", "p95"])
    s = a.groupBy("feature").agg(
        F.count("auc").alias("groups"), F.sum((F.col("auc") < 0.5).cast("int")).alias("below_half"),
        F.sum((F.col("auc") > 0.55).cast("int")).alias("above_055"))
    return s.join(q, "feature")


def residual_edge(df, p_hat, p_mkt, y) -> DataFrame:
    """AUC of the edge and of the score's residual on the market price; partial correlation."""
    st = df.agg(F.struct(
        F.regr_slope(p_hat, p_mkt).alias("b"), F.regr_intercept(p_hat, p_mkt).alias("a"))).scalar()
    d = df.withColumn("_fit", st).withColumns({
        "_edge": F.col(p_hat) - F.col(p_mkt),
        "_res": F.col(p_hat) - (F.col("_fit.a") + F.col("_fit.b") * F.col(p_mkt))})
    g = d.agg(F.corr(p_hat, y).alias("_ry"), F.corr(p_mkt, y).alias("_rm"), F.corr(p_hat, p_mkt).alias("_rx"))
    part = (F.col("_ry") - F.col("_rm") * F.col("_rx")) / F.sqrt((1 - F.col("_rm") ** 2) * (1 - F.col("_rx") ** 2))
    e = auc(d, y, "_edge").agg(F.max("auc")).scalar()
    x = auc(d, y, "_res").agg(F.max("auc")).scalar()
    return g.select(e.alias("auc_edge"), x.alias("auc_residual"), part.alias("partial_corr"))


def consensus_split(df, score, p_side, y, uid, pct=0.01, key=None) -> DataFrame:
    """Top rows by score, split into with and against the market consensus (p > 0.5)."""
    top = top_fraction(df, score, pct, uid)
    w = F.col(p_side) > 0.5
    aggs = [
        F.count(F.lit(1)).alias("n"), F.avg(w.cast("int")).alias("with_share"),
        F.avg(F.when(w, F.col(y))).alias("hit_with"), F.avg(F.when(~w, F.col(y))).alias("hit_against")]
    if key:
        aggs.append(F.countDistinct(key).alias("groups"))
    return top.agg(*aggs)


def seen_vs_novel(train, test, key, y, p) -> DataFrame:
    """Metrics of test rows whose key occurs in train against the rest."""
    d = flag_in(test, train, key, "seen")
    return metrics_by(d, y, p, "seen")


def hit_rate_by_edge(df, edge, y, edges, labels) -> DataFrame:
    """Hit rate and size per right-closed edge bucket."""
    d = df.withColumn("bucket", bin_edges(edge, edges, labels))
    return d.where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.avg(y).alias("hit_rate"), F.count(y).alias("n"))


def falsification(results, model, strategy, roi, naive) -> DataFrame:
    """Best model per strategy against the naive one."""
    best = results.where(F.col(model) != naive).groupBy(strategy).agg(
        F.max_by(model, F.struct(F.col(roi), F.col(model))).alias("best_model"), F.max(roi).alias("best_roi"))
    base = results.where(F.col(model) == naive).select(strategy, F.col(roi).alias("naive_roi"))
    return best.join(base, strategy, "left").withColumn("beats_naive", (F.col("best_roi") > F.col("naive_roi")).cast("int"))
