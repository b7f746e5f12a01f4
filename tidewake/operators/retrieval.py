"""Routing and retrieval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .index import bm25_counts, bm25_index, count_index, frequencies, match_counts, match_index, search_index
from .nearest import block_topk, center_topk
from .ranking import topk_by
from .sampling import with_replicates


def keyword_terms(df, doc, tokens, keywords) -> DataFrame:
    """(doc, term): the keywords among each document's tokens, once each; other tokens are dropped before any row is made."""
    wanted = keywords.agg(F.collect_set("term")).scalar()  # the keywords of all classes
    return df.select(doc, F.explode(F.array_intersect(tokens, wanted)).alias("term")).distinct()


def keyword_hits(tf, doc, keywords, label) -> DataFrame:
    """(doc, label, rank) for each keyword found in the document."""
    return tf.select(doc, "term").join(keywords.select(F.col(label).alias("route"), "term", "rank"), "term")


def keyword_route(tf, doc, keywords, label, docs) -> DataFrame:
    """Class with the most matched keywords (ties to the smaller label), ``unmatched`` without any."""
    s = keyword_hits(tf, doc, keywords, label).groupBy(doc, "route").agg(F.count(F.lit(1)).alias("_n"))
    best = s.groupBy(doc).agg(F.min_by("route", F.struct(-F.col("_n"), F.col("route"))).alias("route"), F.max("_n").alias("matched"))
    return docs.select(doc).join(best, doc, "left").select(
        doc, F.coalesce("route", F.lit("unmatched")).alias("route"), F.coalesce("matched", F.lit(0).cast("bigint")).alias("matched"))


def precision_curve(tf, doc, keywords, label, gold, gold_label, ns) -> DataFrame:
    """Macro precision per keyword depth; every depth is answered from one pass over the hits."""
    ns_arr = F.array(*[F.lit(n) for n in ns])
    h = keyword_hits(tf, doc, keywords, label).join(gold.select(doc, F.col(gold_label).alias("_y")), doc)
    h = h.repartition(doc).withColumn("n", F.explode(F.filter(ns_arr, lambda x: x >= F.col("rank"))))
    s = h.groupBy(doc, "_y", "n", "route").agg(F.count(F.lit(1)).alias("_c"))  # still dealt by document
    best = s.groupBy(doc, "_y", "n").agg(F.min_by("route", F.struct(-F.col("_c"), F.col("route"))).alias("route"))
    per = cut_lineage(best.groupBy("n", "route").agg(F.avg((F.col("route") == F.col("_y")).cast("int")).alias("p")))  # a row per depth and class
    # macro over gold classes, and over predicted classes without gold rows, as 0 when never predicted
    labels = gold.select(F.col(gold_label).alias("route")).distinct().union(per.select("route")).distinct()
    n_l = labels.agg(F.count(F.lit(1))).scalar()
    return per.groupBy("n").agg(F.sum("p").alias("_s")).select("n", (F.col("_s") / n_l).alias("precision_macro"))


def elbow(curve, max_gain=0.01) -> DataFrame:
    """Smallest depth whose gain over the depth before is at most ``max_gain``, else the best depth."""
    w = Window.partitionBy(F.lit(0)).orderBy("n")  # one row per depth
    d = curve.withColumn("_g", F.col("precision_macro") - F.coalesce(F.lag("precision_macro").over(w), F.lit(0.0)))
    return d.agg(F.coalesce(F.min(F.when(F.col("_g") <= max_gain, F.col("n"))), F.max_by("n", "precision_macro")).alias("keyword_n"))


def centroids(df, label, vec) -> DataFrame:
    """Mean vector per class, scaled to length 1; components are averaged with map-side combining."""
    d = df.select(label, F.posexplode(F.col(vec).cast("array<double>")).alias("i", "x"))
    g = d.groupBy(label, "i").agg(F.avg("x").alias("m"))
    c = g.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    norm = F.sqrt(F.aggregate("c", F.lit(0.0), lambda a, x: a + x * x))
    return c.select(label, F.when(norm > 0, F.transform("c", lambda x: x / norm)).otherwise(F.col("c")).alias("centroid"))


def assign(df, uid, vec, cents, label) -> DataFrame:
    """Nearest centroid by cosine."""
    return _nearest(df, uid, vec, cents, label, 1)


def _nearest(df, uid, vec, cents, label, k):
    return center_topk(df.select(uid, F.col(vec).alias("_vec")), cents.select(label, F.col("centroid").alias("_vec")), uid, label, "_vec", k)


def membership(df, uid, vec, own, cents, label, n_classes, threshold=0.25) -> DataFrame:
    """Classes with cosine of at least the threshold, and the own class always."""
    d = _nearest(df, uid, vec, cents, label, n_classes).join(df.select(uid, F.col(own).alias("_own")), uid)
    return d.where((F.col("score") >= threshold) | (F.col(label) == F.col("_own"))).select(uid, label, "score")


def align_topics(topics, tid, tvec, kb, kid, kvec, n_kb, strong=0.6, multi=0.4) -> DataFrame:
    """Single / multi / gap decision from the similarities of a topic to the knowledge-base classes."""
    d = center_topk(topics.select(tid, F.col(tvec).alias("_vec")), kb.select(kid, F.col(kvec).alias("_vec")), tid, kid, "_vec", n_kb)
    g = d.groupBy(tid).agg(
        F.max("score").alias("best"), F.max_by(kid, "score").alias("best_class"), F.sum((F.col("score") >= multi).cast("int")).alias("n_multi"))
    dec = F.when((F.col("best") >= strong) & (F.col("n_multi") <= 1), "single").when(F.col("n_multi") >= 2, "multi").when(
        F.col("best") >= strong, "single").otherwise("gap")
    return g.withColumn("decision", dec)


def dense_topk(q, c, qid, cid, vec, k, restrict=None) -> DataFrame:
    """Exact top-k by cosine, optionally inside a shared class column."""
    return block_topk(q, c, qid, cid, vec, k, restrict=restrict)


def bm25_topk(q_tf, c_tf, qid, cid, n_docs: Column, k, k1=1.5, b=0.75, epsilon=0.25) -> DataFrame:
    """Okapi BM25 top-k over an index built here; keep the index to search it again."""
    return search_index(bm25_index(c_tf, cid, n_docs, k1, b, epsilon), q_tf, qid, cid, k)


def rrf(lists: list[DataFrame], qid, cid, k, k0=60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists."""
    u = reduce(DataFrame.unionByName, [x.select(qid, cid, "rank") for x in lists])
    g = u.groupBy(qid, cid).agg(F.round(F.sum(1 / (k0 + F.col("rank"))), 12).alias("score"))
    return topk_by(g, qid, "score", cid, k)


def rerank_lexical(cand, q_tf, c_tf, qid, cid, n_docs: Column, k, df_=None) -> DataFrame:
    """Candidates re-ordered by TF-IDF cosine with the query; document weights come from the corpus.

    With the frequencies ``df_`` (term, df) of the corpus, ``c_tf`` needs only the candidates.
    """
    df_ = c_tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")) if df_ is None else df_
    idf = df_.select("term", (F.ln((n_docs + 1) / (F.col("df") + 1)) + 1).alias("_idf"))

    def unit(tf, key):
        w = tf.join(idf, "term").withColumn("_w", F.col("tf") * F.col("_idf"))
        n = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)))  # one text's terms
        return w.select(key, "term", (F.col("_w") / n).alias("_w"))

    pairs = cand.select(qid, cid).distinct()
    ds = unit(c_tf.join(pairs.select(cid).distinct(), cid, "left_semi"), cid).withColumnRenamed("_w", "_wd")
    qs = unit(q_tf, qid).withColumnRenamed("_w", "_wq")
    s = pairs.join(qs, qid).join(ds, [cid, "term"]).groupBy(qid, cid).agg(F.sum(F.col("_wq") * F.col("_wd")).alias("_s"))
    g = pairs.join(s, [qid, cid], "left").select(qid, cid, F.round(F.coalesce("_s", F.lit(0.0)), 9).alias("score"))
    return topk_by(g, qid, "score", cid, k)


def retrieval_at_k(ranked, gold, qid, cid, ks, arch="arch", b=500, seed=0) -> DataFrame:
    """Share of queries with a gold item in the first k, with a bootstrap interval, per architecture."""
    archs = ranked.select(arch).distinct()
    q = gold.select(qid).distinct().withColumn("_archs", archs.agg(F.sort_array(F.collect_set(arch))).scalar())
    base = q.select(qid, F.explode("_archs").alias(arch))
    hits = ranked.join(gold.select(qid, cid), [qid, cid]).groupBy(qid, arch).agg(F.min("rank").alias("_r"))
    d = base.join(hits, [qid, arch], "left")
    arr = F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce((F.col("_r") <= k).cast("int"), F.lit(0)).alias("hit")) for k in ks])
    d = d.select(qid, arch, F.explode(arr).alias("x")).select(qid, arch, "x.*")
    # all (architecture, k) cells share the replicate weights of a query
    r = with_replicates(d, qid, b, seed)
    r = r.groupBy(arch, "k", "rep").agg((F.sum(F.col("hit") * F.col("_w")) / F.sum("_w")).alias("v"))
    ci = r.groupBy(arch, "k").agg(F.percentile("v", 0.025).alias("lo"), F.percentile("v", 0.975).alias("hi"))  # b values
    return d.groupBy(arch, "k").agg(F.avg("hit").alias("hit_rate"), F.count(F.lit(1)).alias("n")).join(ci, [arch, "k"])


def multi_label(probs, qid, label, p="p", at_least=0.35, top=2) -> DataFrame:
    """N34 C: every class with p >= at_least; a query without one gets its ``top`` classes."""
    w = Window.partitionBy(qid).orderBy(F.col(p).desc(), label)  # one row per class
    d = probs.withColumn("_r", F.row_number().over(w)).withColumn("_any", F.max((F.col(p) >= at_least).cast("int")).over(Window.partitionBy(qid)))
    return d.where((F.col(p) >= at_least) | ((F.col("_any") == 0) & (F.col("_r") <= top))).select(qid, label)


def route(arch, q, c, qid, cid, vec, label, k, classes=None, rules=None, sparse=None) -> DataFrame:
    """Ranked candidates of one architecture.

    A: dense inside the predicted class; B: rule hits (``rules``: qid, label) take precedence over the
    class; C: dense inside each of several classes; D: dense over everything fused with ``sparse``;
    F: dense inside the top-2 classes.  ``classes`` holds (qid, label) rows.
    """
    if arch == "D":
        dense = block_topk(q, c, qid, cid, vec, k)
        out = rrf([dense, sparse], qid, cid, k) if sparse is not None else dense
    else:
        cl = classes
        if arch == "B" and rules is not None:
            cl = rules.unionByName(classes.join(rules, qid, "left_anti"))
        # one sub-query per (query, class), merged by score afterwards
        both = F.to_json(F.struct(F.col(qid).alias("q"), F.col(label).alias("l")))
        qq = q.join(cl.select(qid, label).distinct(), qid).withColumn("_qc", both)
        got = block_topk(qq, c, "_qc", cid, vec, k, restrict=label).join(qq.select("_qc", qid), "_qc").groupBy(qid, cid).agg(F.max("score").alias("score"))
        out = topk_by(got, qid, "score", cid, k)
    return out.select(qid, cid, "score", "rank").withColumn("arch", F.lit(arch))
