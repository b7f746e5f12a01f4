"""Clustering, neighbours, anomalies and item similarity built from joins."""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml import clustering as mlcl
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage, stored
from .models import _fit
from .nearest import block_topk, center_topk
from .ranking import topk_by


def fit_kmeans(df, cols, k):
    """K-means on standardised columns."""
    return _fit(df, cols, mlcl.KMeans(k=k, seed=0))


def kmeans_sweep(df, cols, ks) -> DataFrame:
    """Inertia and silhouette per k."""
    rows = []
    for k in ks:
        m = fit_kmeans(df, cols, k)
        sil = ClusteringEvaluator(featuresCol="features").evaluate(m.transform(df))
        rows.append((k, float(m.stages[-1].summary.trainingCost), float(sil)))
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")


def kmeans_step(points, centers, uid, cid, vec) -> tuple[DataFrame, DataFrame]:
    """Assignment to the nearest centre (ties to the smaller id) and the new means."""
    a = center_topk(points, centers, uid, cid, vec, 1, metric="l2").select(uid, F.col(cid).alias("cluster"), (-F.col("score")).alias("sq_dist"))
    d = points.select(uid, F.posexplode(F.col(vec).cast("array<double>")).alias("i", "x")).join(a.select(uid, "cluster"), uid)
    m = d.groupBy("cluster", "i").agg(F.avg("x").alias("m"))
    c = m.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias(vec))
    return a, c.withColumnRenamed("cluster", cid)


def cluster_profile(df, cluster, member, t, v) -> DataFrame:
    """Members, mean in the first and last period, percent change."""
    per = df.groupBy(cluster, t).agg(F.avg(v).alias("_m"))
    g = per.groupBy(cluster).agg(F.min_by("_m", t).alias("first_mean"), F.max_by("_m", t).alias("last_mean"))
    n = df.groupBy(cluster).agg(F.countDistinct(member).alias("members"))
    return n.join(g, cluster).withColumn("pct_change", (F.col("last_mean") / F.col("first_mean") - 1) * 100)


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): smallest node id reachable.  Labels spread along edges and jump through their
    own label; each round is cut by a reliable checkpoint and the loop ends when nothing changes."""
    both = cut_lineage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    lab = cut_lineage(nodes.select("node", F.col("node").alias("component")))
    while True:
        near = both.join(lab, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("m"))
        nxt = lab.join(near, F.col("node") == F.col("a"), "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component"), F.col("component").alias("old"))
        jump = nxt.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        nxt = nxt.join(jump, F.col("component") == F.col("_n"), "left").select("node", F.least("component", F.coalesce("_c", "component")).alias("component"), "old")
        nxt = cut_lineage(nxt)
        changed = nxt.where("component <> old").limit(1).count()
        lab = nxt.select("node", "component")
        if not changed:
            return lab


def dbscan(df, uid, cols, eps, min_samples) -> DataFrame:
    """(id, cluster, core): cluster is the smallest core id of its component, -1 is noise.

    Grid cells have diagonal eps, so points of one cell are neighbours without being paired: a cell of
    at least ``min_samples`` points is all core, and the core points of a cell share a cluster.  Points
    of thin cells meet the points of nearby cells.  Two core cells are linked by their sub-cell boxes
    where those decide; only undecided sub-cell pairs compare points.  A border point takes the
    smallest cluster in reach.
    """
    d = len(cols)
    side = eps / math.sqrt(d) * (1 - 1e-12)
    reach = math.ceil(math.sqrt(d))
    fine = 8
    e2 = eps * eps

    def cell_id(parts):
        return F.concat_ws(",", *parts)

    p = df.select(F.col(uid).alias("id"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    cs = [F.floor(F.col(f"x{i}") / side) for i in range(d)]
    subs = [F.floor((F.col(f"x{i}") / side - cs[i]) * fine) for i in range(d)]
    p = p.withColumns({f"c{i}": cs[i] for i in range(d)}).withColumn("cell", cell_id([F.col(f"c{i}") for i in range(d)])).withColumn("sub", cell_id(subs))
    size = p.groupBy("cell").agg(F.count(F.lit(1)).alias("n_cell"))
    p = cut_lineage(p.join(size, "cell"))
    offsets = [o for o in product(range(-reach, reach + 1), repeat=d) if any(o)]

    def around(q):
        near = F.array(*[cell_id([F.col(f"c{i}") + o[i] for i in range(d)]) for o in offsets])
        return q.withColumn("near", F.explode(near))

    def dist2(a, b):
        s = F.lit(0.0)
        for i in range(d):
            t = F.col(f"{a}.x{i}") - F.col(f"{b}.x{i}")
            s = s + t * t
        return s

    thin = around(p.where(F.col("n_cell") < min_samples))
    extra = (thin.alias("a").join(p.alias("b"), F.col("a.near") == F.col("b.cell")).where(dist2("a", "b") <= e2)
             .groupBy(F.col("a.id").alias("id")).agg(F.count(F.lit(1)).alias("n_near")))
    p = p.join(extra, "id", "left").withColumn("core", (F.coalesce("n_near", F.lit(0)) + F.col("n_cell") >= min_samples).cast("int"))
    p = cut_lineage(p)
    core = p.where("core = 1")
    nodes = core.groupBy("cell").agg(F.min("id").alias("node"))
    box = core.groupBy("cell", "sub", *[f"c{i}" for i in range(d)]).agg(
        *[F.min(f"x{i}").alias(f"lo{i}") for i in range(d)], *[F.max(f"x{i}").alias(f"hi{i}") for i in range(d)])
    pair = around(box).alias("a").join(box.alias("b"), (F.col("a.near") == F.col("b.cell")) & (F.col("a.cell") < F.col("b.cell")))
    near2, far2 = F.lit(0.0), F.lit(0.0)
    for i in range(d):
        gap = F.greatest(F.col(f"a.lo{i}") - F.col(f"b.hi{i}"), F.col(f"b.lo{i}") - F.col(f"a.hi{i}"), F.lit(0.0))
        span = F.greatest(F.col(f"a.hi{i}") - F.col(f"b.lo{i}"), F.col(f"b.hi{i}") - F.col(f"a.lo{i}"))
        near2, far2 = near2 + gap * gap, far2 + span * span
    pair = pair.where(near2 <= e2).select(
        F.col("a.cell").alias("ca"), F.col("a.sub").alias("sa"), F.col("b.cell").alias("cb"), F.col("b.sub").alias("sb"), (far2 <= e2).alias("sure"))
    pair = cut_lineage(pair)
    sure = pair.where("sure").select("ca", "cb").distinct()
    open_ = pair.where("NOT sure").join(sure, ["ca", "cb"], "left_anti")
    a = core.select(F.col("cell").alias("ca"), F.col("sub").alias("sa"), F.struct(*[f"x{i}" for i in range(d)]).alias("a"))
    b = core.select(F.col("cell").alias("cb"), F.col("sub").alias("sb"), F.struct(*[f"x{i}" for i in range(d)]).alias("b"))
    found = open_.join(a, ["ca", "sa"]).join(b, ["cb", "sb"]).where(dist2("a", "b") <= e2).select("ca", "cb").distinct()
    links = sure.union(found)
    na, nb = nodes.select(F.col("cell").alias("ca"), F.col("node").alias("a")), nodes.select(F.col("cell").alias("cb"), F.col("node").alias("b"))
    comp = connected_components(links.join(na, "ca").join(nb, "cb").select("a", "b"), nodes)
    cell_c = nodes.join(comp, "node").select("cell", "component")
    inside = p.join(cell_c, "cell", "left")
    core_out = inside.where("core = 1").select("id", F.col("component").alias("cluster"), "core")
    rest = inside.where("core = 0")
    corec = core.join(cell_c, "cell")
    reach_out = (around(rest.drop("component")).alias("a").join(corec.alias("b"), F.col("a.near") == F.col("b.cell")).where(dist2("a", "b") <= e2)
                 .groupBy(F.col("a.id").alias("id")).agg(F.min("b.component").alias("far")))
    border = rest.join(reach_out, "id", "left").select(
        "id", F.coalesce(F.least("component", "far"), F.lit(-1)).alias("cluster"), "core")
    return core_out.unionByName(border).withColumnRenamed("id", uid)


def knn_classify(train, test, uid, tid, vec, y, k, search=block_topk) -> DataFrame:
    """Majority vote of the k nearest training rows (ties to the smaller label); ``search`` may be ``lsh_topk``."""
    n = search(test, train, uid, tid, vec, k, metric="l2")
    n = n.join(train.select(tid, F.col(y).alias("_y")), tid)
    v = n.groupBy(uid, "_y").agg(F.count(F.lit(1)).alias("_n"))
    return v.groupBy(uid).agg(F.min_by("_y", F.struct(-F.col("_n"), F.col("_y"))).alias("prediction"))


def knn_grid(train, test, uid, tid, vec, y, ks) -> DataFrame:
    """Accuracy per k from one neighbour search with the largest k."""
    n = block_topk(test, train, uid, tid, vec, max(ks), metric="l2").join(train.select(tid, F.col(y).alias("_y")), tid)
    n = n.withColumn("k", F.explode(F.filter(F.array(*[F.lit(x) for x in ks]), lambda x: x >= F.col("rank"))))
    v = n.groupBy(uid, "k", "_y").agg(F.count(F.lit(1)).alias("_n"))
    p = v.groupBy(uid, "k").agg(F.min_by("_y", F.struct(-F.col("_n"), F.col("_y"))).alias("_p"))
    return p.join(test.select(uid, F.col(y).alias("_t")), uid).groupBy("k").agg(F.avg((F.col("_p") == F.col("_t")).cast("int")).alias("accuracy"))


def zscore_flags(df, col, z=3.0, out="z_flag") -> DataFrame:
    """|x - mean| / std above z."""
    st = df.agg(F.struct(F.avg(col).alias("m"), F.stddev_samp(col).alias("s"))).scalar()
    d = df.withColumn("_st", st)
    return d.withColumn("z", (F.col(col) - F.col("_st.m")) / F.col("_st.s")).withColumn(out, (F.abs("z") > z).cast("int")).drop("_st")


def detector_agreement(df, a, b) -> DataFrame:
    """Rows flagged by either, both, and their overlap share."""
    both, any_ = F.sum(((F.col(a) == 1) & (F.col(b) == 1)).cast("int")), F.sum(((F.col(a) == 1) | (F.col(b) == 1)).cast("int"))
    return df.agg(F.sum(a).alias("n_a"), F.sum(b).alias("n_b"), both.alias("n_both"), F.when(any_ > 0, both / any_).alias("jaccard"))


def item_stats(ratings, item, rating) -> DataFrame:
    """Number and mean of the ratings per item."""
    return ratings.groupBy(item).agg(F.count(rating).alias("n"), F.avg(rating).alias("mean"))


def similar_items(ratings, user, item, rating, min_n, k, block=2048, users_per_slice=4096, heavy=512) -> DataFrame:
    """Pearson correlation over co-raters for every item pair with at least min_n of them, top-k per item.

    Items rated fewer than min_n times cannot qualify and leave first.  Users of at most ``heavy`` items meet their items
    in pairs, so copies grow with the ratings; pairs are counted first, and only those with min_n co-raters get sums.  For
    heavier users items are cut into blocks and users into slices; a task takes two item blocks of one slice and adds up the
    six co-rating sums, so a heavy user is spread over blocks and only sums leave a task.  Dense slices use matrix products,
    thin ones add up their co-ratings directly; block and slice sizes bound both.
    """
    r = ratings.groupBy(user, item).agg(F.avg(rating).alias("v"))
    often = r.groupBy(item).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") >= min_n).select(item)
    d = r.join(often, item).select(F.col(user).alias("u"), F.col(item).cast("bigint").alias("i"), "v")
    d = stored(d.join(d.groupBy("u").agg(F.count(F.lit(1)).alias("_c")), "u"))
    light, big = d.where(F.col("_c") <= heavy).select("u", "i", "v"), d.where(F.col("_c") > heavy).select("u", "i", "v")
    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    n_big = big.select("u").distinct().count()
    rest = stored(_block_sums(big, block, users_per_slice, n_big, names)) if n_big else None

    def pairs(x):
        return x.alias("l").join(x.alias("r"), (F.col("l.u") == F.col("r.u")) & (F.col("l.i") < F.col("r.i")))

    met = pairs(light.select("u", "i")).select(F.col("l.i").alias("i"), F.col("r.i").alias("j"), F.lit(1.0).alias("n"))
    if n_big:
        met = met.unionByName(rest.select("i", "j", "n"))
    enough = stored(met.groupBy("i", "j").agg(F.sum("n").alias("n")).where(F.col("n") >= min_n).select("i", "j"))
    able = enough.select("i").union(enough.select(F.col("j").alias("i"))).distinct()
    x, y = F.col("l.v"), F.col("r.v")
    sums = {"n": F.lit(1.0), "sx": x, "sy": y, "sxx": x * x, "syy": y * y, "sxy": x * y}
    got = pairs(light.join(able, "i", "left_semi")).select(F.col("l.i").alias("i"), F.col("r.i").alias("j"), *[c.alias(nm) for nm, c in sums.items()])
    if n_big:
        got = got.unionByName(rest)
    g = got.join(enough, ["i", "j"], "left_semi").groupBy("i", "j").agg(*[F.sum(nm).alias(nm) for nm in names])
    n = F.col("n")
    vx, vy = n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("syy") - F.col("sy") * F.col("sy")
    corr = (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(vx * vy)
    g = g.where((vx > 1e-9) & (vy > 1e-9)).select("i", "j", n.cast("bigint").alias("n"), F.round(corr, 9).alias("corr"))
    two = g.unionByName(g.select(F.col("j").alias("i"), F.col("i").alias("j"), "n", "corr"))
    return topk_by(two, "i", "corr", "j", k).withColumnsRenamed({"i": item, "j": f"similar_{item}"})


def _block_sums(r, block, users_per_slice, n_users, names) -> DataFrame:
    """The six sums per item pair i < j over the ratings (u, i, v), each from pairs of item blocks in slices of users."""
    n_items = r.agg(F.approx_count_distinct("i")).first()[0]
    blocks, slices = max(1, -(-n_items // block)), max(1, -(-n_users // users_per_slice))
    d = r.select("u", "i", "v", F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int").alias("_b"), F.pmod(F.xxhash64("u", F.lit("s")), F.lit(slices)).cast("int").alias("_s"))
    left = d.withColumn("a", F.col("_b")).withColumn("b", F.explode(F.sequence(F.col("_b"), F.lit(blocks - 1))))
    right = d.toDF(*d.columns).withColumn("b", F.col("_b")).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("_b"))))

    def dense(pdf, users):
        items = np.unique(pdf["i"].to_numpy())
        x = np.zeros((len(users), len(items)))
        m = np.zeros_like(x)
        ui, ii = np.searchsorted(users, pdf["u"].to_numpy()), np.searchsorted(items, pdf["i"].to_numpy())
        x[ui, ii] = pdf["v"].to_numpy()
        m[ui, ii] = 1.0
        return items, x, m

    def part(key, l: pd.DataFrame, rr: pd.DataFrame) -> pd.DataFrame:
        users = np.intersect1d(l["u"].to_numpy(), rr["u"].to_numpy())
        l, rr = l[l["u"].isin(users)], rr[rr["u"].isin(users)]
        work = int((l["u"].value_counts() * rr["u"].value_counts()).sum())
        if len(users) and work < l["i"].nunique() * rr["i"].nunique() * len(users) / 40:
            z = l[["u", "i", "v"]].merge(rr[["u", "i", "v"]], on="u")
            x, y = z["v_x"].to_numpy(), z["v_y"].to_numpy()
            li, p = np.unique(z["i_x"].to_numpy(), return_inverse=True)
            ri, q = np.unique(z["i_y"].to_numpy(), return_inverse=True)
            cell, at = np.unique(p * np.int64(len(ri)) + q, return_inverse=True)
            sums = [np.bincount(at, w, len(cell)) for w in (np.ones(len(x)), x, y, x * x, y * y, x * y)]
            i, j = li[cell // len(ri)], ri[cell % len(ri)]
            keep = (i < j) if key[0] == key[1] else np.ones(len(i), bool)
            return pd.DataFrame({"i": i[keep], "j": j[keep], **{nm: v[keep] for nm, v in zip(names, sums)}})
        if not len(users):
            return pd.DataFrame({"i": [], "j": [], **{x: [] for x in names}}).astype({"i": "int64", "j": "int64"} | {x: "float64" for x in names})
        li, x, mx = dense(l, users)
        ri, y, my = dense(rr, users)
        sums = [mx.T @ my, x.T @ my, mx.T @ y, (x * x).T @ my, mx.T @ (y * y), x.T @ y]
        p, q = np.nonzero((sums[0] > 0) & ((key[0] != key[1]) | (li[:, None] < ri[None, :])))
        return pd.DataFrame({"i": li[p], "j": ri[q], **{nm: s[p, q] for nm, s in zip(names, sums)}})

    got = left.groupBy("a", "b", "_s").cogroup(right.groupBy("a", "b", "_s")).applyInPandas(
        part, "i bigint, j bigint, n double, sx double, sy double, sxx double, syy double, sxy double")
    turned = {"i": "j", "j": "i", "sx": "sy", "sy": "sx", "sxx": "syy", "syy": "sxx"}  # blocks are in order, their items are not
    return got.select(*[F.when(F.col("i") > F.col("j"), F.col(turned.get(c, c))).otherwise(F.col(c)).alias(c) for c in got.columns])
