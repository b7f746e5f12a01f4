"""T: feature transforms and models.  Everything is fitted on the training table only."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml import classification as mlc, clustering as mlcl, feature as mlf, regression as mlr
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.scalars import unit_hash
from ..session import cut_lineage
from .evaluate import auc, ece
from .isotonic import apply_isotonic, fit_isotonic
from .ordering import bucket_count, join_scan, quantiles, value_counts_scan
from .sampling import ts_cv
from .timeline import prior
from .topics import TopicModel, best_terms, fit_topics, number_terms
from .wordvec import WordVectors, fit_words


def _stats(train, aggs: dict[str, Column]) -> Column:
    """One-row statistics of the training table as a scalar struct."""
    return train.agg(F.struct(*[c.alias(n) for n, c in aggs.items()])).scalar()


def standard_scale(train, df, cols) -> DataFrame:
    """(x - mean) / population deviation of train; a constant column becomes 0."""
    st = _stats(train, {f"m_{c}": F.avg(c) for c in cols} | {f"s_{c}": F.stddev_pop(c) for c in cols})
    d = df.withColumn("_st", st)
    return d.withColumns({c: F.coalesce((F.col(c) - F.col(f"_st.m_{c}")) / F.nullif(F.col(f"_st.s_{c}"), F.lit(0.0)), F.lit(0.0)) for c in cols}).drop("_st")


def minmax_scale(train, df, cols) -> DataFrame:
    """(x - min) / (max - min) of train."""
    st = _stats(train, {f"a_{c}": F.min(c) for c in cols} | {f"z_{c}": F.max(c) for c in cols})
    d = df.withColumn("_st", st)
    return d.withColumns({c: (F.col(c) - F.col(f"_st.a_{c}")) / F.nullif(F.col(f"_st.z_{c}") - F.col(f"_st.a_{c}"), F.lit(0.0)) for c in cols}).drop("_st")


def impute(train, df, cols, strategy="mean") -> DataFrame:
    """Nulls take the train mean, exact median or most frequent value (ties to the smaller)."""
    fills = {}
    for c in cols:
        if strategy == "mean":
            fills[c] = train.agg(F.avg(c)).scalar()
        elif strategy == "median":
            fills[c] = quantiles(train, c, [0.5], names=["m"]).agg(F.max("m")).scalar()
        else:
            g = train.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
            fills[c] = g.agg(F.min_by(c, F.struct(-F.col("_n"), F.col(c)))).scalar()
    return df.withColumns({c: F.coalesce(F.col(c), fills[c]) for c in cols})


def encode_ordinal(df, col, order=None, out=None) -> DataFrame:
    """Position in a given order, or in the alphabetical order of the categories.

    Without an order the categories are numbered inside buckets of their first two characters, shifted by the buckets before, and
    meet the rows by a join, so there may be any number of them.
    """
    out = out or f"{col}_code"
    if order:
        pos = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(col))
        return df.withColumn(out, F.when(pos > 0, pos - 1))
    d = df.select(F.col(col).alias("_c")).where("_c is not null").distinct().withColumn("_b", F.substring(F.col("_c").cast("string"), 1, 2))
    d = d.withColumn("_i", F.row_number().over(Window.partitionBy("_b").orderBy("_c")) - 1)
    before = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    start = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    codes = d.join(start, "_b").select("_c", (F.col("_s") + F.col("_i")).cast("bigint").alias(out))
    return df.drop(out).join(codes, F.col(col) == F.col("_c"), "left").drop("_c")


def one_hot(df, col, values, prefix=None) -> DataFrame:
    """One 0/1 column per category."""
    return df.withColumns({f"{prefix or col}_{v}": F.coalesce((F.col(col) == v).cast("int"), F.lit(0)) for v in values})


def preprocess_pipeline(num_cols, cat_cols, out="features") -> Pipeline:
    """Impute and scale numbers, index and one-hot encode categories, one vector."""
    stages = [
        mlf.Imputer(inputCols=num_cols, outputCols=[f"_{c}" for c in num_cols], strategy="median"),
        mlf.VectorAssembler(inputCols=[f"_{c}" for c in num_cols], outputCol="_num"),
        mlf.StandardScaler(inputCol="_num", outputCol="_numz", withMean=True),
    ]
    if cat_cols:
        stages += [
            mlf.StringIndexer(inputCols=cat_cols, outputCols=[f"_{c}_i" for c in cat_cols], handleInvalid="keep"),
            mlf.OneHotEncoder(inputCols=[f"_{c}_i" for c in cat_cols], outputCols=[f"_{c}_v" for c in cat_cols]),
        ]
    stages.append(mlf.VectorAssembler(inputCols=["_numz", *[f"_{c}_v" for c in cat_cols]], outputCol=out))
    return Pipeline(stages=stages)


def winsorise(train, df, cols, lo=0.01, hi=0.99) -> DataFrame:
    """Bound values by exact train quantiles."""
    for c in cols:
        q = quantiles(train, c, [lo, hi], names=["a", "z"]).agg(F.max(F.struct("a", "z"))).scalar()
        df = df.withColumn("_q", q).withColumn(c, F.when(F.col(c).isNotNull(), F.greatest(F.col("_q.a"), F.least(F.col("_q.z"), F.col(c))))).drop("_q")
    return df


def _features(cols, scale=True):
    stages = [mlf.VectorAssembler(inputCols=list(cols), outputCol="_raw" if scale else "features")]
    if scale:
        stages.append(mlf.StandardScaler(inputCol="_raw", outputCol="features", withMean=True))
    return stages


def _fit(train, cols, est, scale=True, extra=()):
    return Pipeline(stages=[*_features(cols, scale), *extra, est]).fit(train)


def fit_pca(train, cols, k=None):
    """Components on standardised columns, explained variance, elbow and counts for 90/95 %.

    The elbow is the component farthest from the chord of the cumulative curve.
    """
    k_all = len(cols)
    m = _fit(train, cols, mlf.PCA(k=k or k_all, inputCol="features", outputCol="pca"))
    ev = [float(x) for x in m.stages[-1].explainedVariance]
    cum, run = [], 0.0
    for x in ev:
        run += x
        cum.append(run)
    n = len(cum)
    chord = [abs((cum[-1] - cum[0]) * i - (n - 1) * (cum[i] - cum[0])) for i in range(n)]
    info = {
        "explained": ev, "elbow": max(range(n), key=lambda i: chord[i]) + 1,
        "k90": next((i + 1 for i, c in enumerate(cum) if c >= 0.90), n), "k95": next((i + 1 for i, c in enumerate(cum) if c >= 0.95), n),
    }
    return m, info


def fit_linear(train, cols, y):
    """Least squares; R2 in ``model.stages[-1].summary.r2``."""
    return _fit(train, cols, mlr.LinearRegression(labelCol=y), scale=False)


def fit_elastic(train, cols, y, reg=0.1, l1=0.5):
    """Ridge (l1=0), lasso (l1=1) or elastic net on standardised columns."""
    return _fit(train, cols, mlr.LinearRegression(labelCol=y, regParam=reg, elasticNetParam=l1, solver="auto"))


def selected_features(model, cols) -> list[str]:
    """Columns with a non-zero coefficient."""
    return [c for c, b in zip(cols, model.stages[-1].coefficients) if abs(b) > 1e-10]


def fit_poly(train, cols, y, degree=3, reg=0.0, l1=0.0):
    """Polynomial expansion with a regularised fit."""
    poly = mlf.PolynomialExpansion(degree=degree, inputCol="features", outputCol="poly")
    est = mlr.LinearRegression(labelCol=y, featuresCol="poly", regParam=reg, elasticNetParam=l1)
    return _fit(train, cols, est, extra=[poly])


def class_weights(df, y, out="weight") -> DataFrame:
    """N / (k * n_class) per row."""
    g = df.groupBy(F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_n"))
    n, k = g.agg(F.sum("_n")).scalar(), g.agg(F.count(F.lit(1))).scalar()
    return df.join(g, F.col(y) == F.col("_y"), "left").withColumn(out, n / (k * F.col("_n"))).drop("_y", "_n")


def fit_logistic(train, cols, y, reg=0.0, l1=0.0, balanced=False, family="auto", iters=100):
    """Logistic regression, optionally with balanced class weights or multinomial."""
    if balanced:
        train = class_weights(train, y, "_weight")
    est = mlc.LogisticRegression(labelCol=y, regParam=reg, elasticNetParam=l1, family=family, maxIter=iters)
    return _fit(train, cols, est.setWeightCol("_weight") if balanced else est)


def fit_tree(train, cols, y, depth=8, min_leaf=1):
    """Decision tree; rules in ``model.stages[-1].toDebugString``."""
    return _fit(train, cols, mlc.DecisionTreeClassifier(labelCol=y, maxDepth=depth, minInstancesPerNode=min_leaf, seed=0), False)


def fit_forest(train, cols, y, n=100, depth=8, kind="class"):
    """Random forest; importances in ``model.stages[-1].featureImportances``."""
    c = mlc.RandomForestClassifier if kind == "class" else mlr.RandomForestRegressor
    return _fit(train, cols, c(labelCol=y, numTrees=n, maxDepth=depth, seed=0), False)


def fit_gbt(train, cols, y, iters=50, depth=4):
    """Gradient-boosted trees."""
    return _fit(train, cols, mlc.GBTClassifier(labelCol=y, maxIter=iters, maxDepth=depth, seed=0), False)


def fit_pca_logistic(train, cols, y, k):
    """Logistic regression on k principal components."""
    pca = mlf.PCA(k=k, inputCol="features", outputCol="pca")
    return _fit(train, cols, mlc.LogisticRegression(labelCol=y, featuresCol="pca"), extra=[pca])


def fit_mlp(train, cols, y, hidden=(16,), classes=2, iters=50):
    """Multi-layer perceptron."""
    est = mlc.MultilayerPerceptronClassifier(labelCol=y, layers=[len(cols), *hidden, classes], seed=0, maxIter=iters)
    return _fit(train, cols, est)


def fit_linear_svm(train, cols, y, classes=2, iters=50):
    """Linear SVM, one against the rest beyond two classes."""
    svc = mlc.LinearSVC(labelCol=y, maxIter=iters)
    return _fit(train, cols, svc if classes == 2 else mlc.OneVsRest(classifier=svc, labelCol=y))


def tree_rules(spark, model, cols) -> DataFrame:
    """The rules of a tree, one line per node: (line, depth, rule); their number is bounded by the tree's depth."""
    lines = model.stages[-1].toDebugString.rstrip().split("\n")[1:]
    named = [re.sub(r"feature (\d+)", lambda m: cols[int(m[1])], x) for x in lines]
    rows = [(i, len(x) - len(x.lstrip()) - 1, x.strip()) for i, x in enumerate(named)]
    return spark.createDataFrame(rows, "line int, depth int, rule string")


def importances(spark, model, cols) -> DataFrame:
    """Importance of each column in a tree model: (column, importance), one row per column."""
    rows = [(c, float(x)) for c, x in zip(cols, model.stages[-1].featureImportances.toArray())]
    return spark.createDataFrame(rows, "column string, importance double")


def fit_text_svm(train, tokens, y, features=1 << 16, iters=30, reg=0.01):
    """Linear SVM on hashed TF-IDF features of token lists."""
    return Pipeline(stages=[
        mlf.HashingTF(inputCol=tokens, outputCol="_tf", numFeatures=features), mlf.IDF(inputCol="_tf", outputCol="features"),
        mlc.LinearSVC(labelCol=y, maxIter=iters, regParam=reg)]).fit(train)


def score(model, df, keep, p="p") -> DataFrame:
    """Kept columns, predicted class and, where the model has one, the probability of class 1."""
    d = model.transform(df)
    cols = [*keep, "prediction"]
    if "probability" in d.columns:
        d = d.withColumn(p, F.get(vector_to_array("probability"), F.lit(1)))
        cols.append(p)
    return d.select(*cols)


def fit_gmm(train, cols, k):
    """Gaussian mixture."""
    return _fit(train, cols, mlcl.GaussianMixture(k=k, seed=0))


def regime_stats(model, df, value, vol) -> DataFrame:
    """Size, mean and volatility per regime, numbered by rising volatility."""
    g = model.transform(df).groupBy("prediction").agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.avg(vol).alias("volatility"))
    return g.withColumn("regime", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("volatility")) - 1)  # k rows


def fit_platt(val, p, y):
    """Logistic regression on the score's log odds."""
    return fit_logistic(_logit(val.select(p, y), p), ["_logit"], y)


def _logit(df, p):
    c = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(p)))
    return df.withColumn("_logit", F.ln(c / (1 - c)))


def apply_platt(model, df, p, out="p_cal") -> DataFrame:
    keep = [c for c in df.columns if c not in (out, "prediction", "probability")]
    d = model.transform(_logit(df.select(*keep), p))
    return d.select(*keep, F.get(vector_to_array("probability"), F.lit(1)).alias(out))


def fit_calibrator(val, p, y, fold, k, n_bins=10):
    """(name, fitted calibrator, ECE per candidate); the choice minimises the ECE of grouped
    cross-validated predictions."""
    kinds = {"isotonic": (fit_isotonic, apply_isotonic), "platt": (fit_platt, apply_platt)}
    result = {}
    for name, (fit, use) in kinds.items():
        parts = [use(fit(val.where(F.col(fold) != i), p, y), val.where(F.col(fold) == i), p).select(y, "p_cal") for i in range(k)]
        result[name] = float(ece(reduce(DataFrame.unionByName, parts), y, "p_cal", n_bins).first()[0])
    best = min(result, key=lambda n: (result[n], n))
    return best, kinds[best][0](val, p, y), result


def oof_predictions(df, fit: Callable, fold, k, keep) -> DataFrame:
    """Every row scored by the model that did not see its fold."""
    parts = [score(fit(df.where(F.col(fold) != i)), df.where(F.col(fold) == i), keep) for i in range(k)]
    return reduce(DataFrame.unionByName, parts)


def fit_stack(oof, cols, y):
    """Logistic meta-learner on base scores."""
    return fit_logistic(oof, cols, y)


def cv_rows(df, fold, k) -> DataFrame:
    """Rows listed once per fold they join: role ``test`` in their own, ``train`` in the others."""
    return df.withColumn("_own", F.col(fold)).withColumn(fold, F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn(
        "role", F.when(F.col("_own") == F.col(fold), "test").otherwise("train")).drop("_own")


def time_folds(df, t, k) -> DataFrame:
    """``k`` expanding folds over time: rows are cut into k + 1 equal periods (rows of one instant stay together), fold f trains
    on the first f + 1 periods and tests on the next one (columns fold and role)."""
    s = value_counts_scan(df, t)
    period = F.least(F.lit(k), F.floor((F.col("n_below") / F.col("n_all")) * (k + 1))).cast("int")
    return ts_cv(join_scan(df, s.select(t, period.alias("_period")), t), "_period", 1, 1, k).drop("_period")


def grid_search(rows, fit: Callable, grid: list[dict], y, threads=4) -> DataFrame:
    """(setting, mean AUC over folds, number of folds) of every setting, from the fold table ``rows`` (fold, role).

    The fits of all settings and folds run concurrently; their test scores are rated in one pass.  A fold of one class counts 0.5.
    """
    folds = sorted(r[0] for r in rows.select("fold").distinct().collect())

    def run(job):
        i, f = job
        model = fit(rows.where((F.col("fold") == f) & (F.col("role") == "train")), **grid[i])
        return score(model, rows.where((F.col("fold") == f) & (F.col("role") == "test")), [y]).select(F.lit(i).alias("setting"), F.lit(f).alias("fold"), y, "p")

    with ThreadPool(threads) as pool:
        parts = pool.map(inheritable_thread_target(rows.sparkSession)(run), [(i, f) for i in range(len(grid)) for f in folds])
    each = auc(cut_lineage(reduce(DataFrame.unionByName, parts)), y, "p", by=["setting", "fold"])
    return each.groupBy("setting").agg(F.avg(F.coalesce("auc", F.lit(0.5))).alias("auc"), F.count(F.lit(1)).alias("folds"))


def permuted(df, uid, col, seed=0) -> DataFrame:
    """The table with one column shuffled: row i in one hash order takes the value of row i in another."""

    def numbered(d, s, out):
        d = d.withColumn("_u", unit_hash(uid, seed=s)).withColumn("_at", F.floor(F.col("_u") * (1 << 20)))
        width = (1 << 20) // (4 * bucket_count(df.sparkSession))
        return prior(d, [], "_at", ("_u", uid), {out: ("count", F.lit(1))}, slice_secs=width).drop("_u", "_at")

    a = numbered(df, f"{seed}a", "_i")
    b = numbered(df.select(uid, F.col(col).alias("_new")), f"{seed}b", "_i").select("_i", "_new")
    return a.join(b, "_i").withColumn(col, F.col("_new")).drop("_i", "_new")


def permutation_importance(model, df, cols, y, uid, repeats=3) -> DataFrame:
    """AUC lost when a column is shuffled, mean and deviation over repeats."""
    base = auc(score(model, df, [y]), y, "p").agg(F.max("auc")).scalar()
    parts = []
    for c in cols:
        for i in range(repeats):
            d = score(model, permuted(df, uid, c, i), [y])
            parts.append(auc(d, y, "p").select(F.lit(c).alias("column"), (base - F.col("auc")).alias("drop")))
    return reduce(DataFrame.unionByName, parts).groupBy("column").agg(
        F.avg("drop").alias("importance"), F.stddev_pop("drop").alias("std"))


def group_identity_audit(train, test, cols, group, n_trees=30, depth=6) -> DataFrame:
    """How well the group id can be told from the features: top-1 and top-5 rates against chance."""
    idx = mlf.StringIndexer(inputCol=group, outputCol="_g", handleInvalid="skip").fit(train)
    tr, te = idx.transform(train), idx.transform(test)
    m = fit_forest(tr, cols, "_g", n_trees, depth)
    d = m.transform(te).withColumn("_p", vector_to_array("probability"))
    own = F.get("_p", F.col("_g").cast("int"))
    above = F.size(F.filter("_p", lambda x: x > own))
    k = len(idx.labels)
    return d.agg(
        F.avg((above == 0).cast("int")).alias("top1"), F.avg((above < 5).cast("int")).alias("top5"),
        F.lit(1.0 / k).alias("random_top1"), F.lit(min(5, k) / k).alias("random_top5"), F.count(F.lit(1)).alias("n"))


# ---- topics and vectors of text ---------------------------------------------------------------


def term_ids(df, tokens) -> DataFrame:
    """(term, id) with ids 0, 1, 2, ..."""
    return number_terms(df.select(F.explode(tokens).alias("term")).distinct())


def lda(df, doc, tokens, k, tfidf=False, iters=20) -> TopicModel:
    """LDA on counts (or TF-IDF weights) of all terms; one pass over the documents in ``iters`` turns."""
    return fit_topics(df, doc, tokens, [k], tfidf, iters)


def top_words(model: TopicModel, n=10) -> DataFrame:
    """(topic, rank, term, weight); rank 0 is the weakest of the n words."""
    return best_terms(model, n).select("topic", "rank", "term", "weight")


def allocate(model: TopicModel, df, doc, tokens="tokens") -> DataFrame:
    """Topic mixture and main topic of (unseen) documents."""
    d = model.transform(df, doc, tokens).select(doc, F.col("mixtures")[0].alias("mixture"))
    return d.select(doc, "mixture", (F.array_position("mixture", F.array_max("mixture")) - 1).alias("topic"))


def select_k(df, doc, tokens, y, corpus, fold, ks, threads=4) -> DataFrame:
    """Mean coherence over the ``corpus`` (doc, tokens) and held-out macro-F1 of a classifier on topic mixtures per k, ranked by
    the sum of both ranks.  The models are fitted side by side."""
    from .evaluate import classification_report
    from .retrieval import keyword_terms
    from .textops import umass

    ks = list(ks)
    m = fit_topics(df.where(F.col(fold) != 0), doc, tokens, ks)
    words = cut_lineage(best_terms(m, 10).select("model", (F.col("model") * 1000 + F.col("topic")).alias("topic"), "rank", "term"))
    per = umass(keyword_terms(corpus, doc, tokens, words), doc, words.drop("model"))
    coh = {r["model"]: r["coherence"] for r in per.groupBy((F.col("topic") / 1000).cast("int").alias("model")).agg(F.avg("coherence").alias("coherence")).collect()}
    mixed = cut_lineage(m.transform(df, doc, tokens).join(df.select(doc, fold, y), doc).select(fold, y, "mixtures"))

    def run(i):
        t = mixed.select(fold, y, array_to_vector(F.col("mixtures")[i]).alias("features"))
        clf = mlc.LogisticRegression(labelCol=y).fit(t.where(F.col(fold) != 0))
        p = clf.transform(t.where(F.col(fold) == 0)).withColumn("prediction", F.col("prediction").cast("int"))
        f1 = classification_report(p, y, "prediction").where("label = 'macro avg'").first()["f1"]
        return ks[i], float(coh[i]), float(f1)

    with ThreadPool(threads) as pool:  # the classifiers are fitted concurrently
        rows = pool.map(inheritable_thread_target(df.sparkSession)(run), range(len(ks)))
    d = df.sparkSession.createDataFrame(rows, "k int, coherence double, macro_f1 double")
    w = Window.partitionBy(F.lit(0))  # one row per k
    s = F.rank().over(w.orderBy(F.col("coherence").desc())) + F.rank().over(w.orderBy(F.col("macro_f1").desc()))
    return d.withColumn("rank_sum", s)


def word2vec_docs(df, doc, tokens, size=32, min_count=1, out="vector") -> tuple[WordVectors, DataFrame]:
    """Skip-gram vectors fitted on the token lists, and (doc, vector): documents are the mean of their word vectors."""
    m, placed, parts = fit_words(df, doc, tokens, size, min_count)
    return m, m.mean_vectors(placed, doc, parts, out)


def cluster_taxonomy(vectors, doc, vec, k=None, out="class_label") -> DataFrame:
    """Classes by k-means over document vectors, for a knowledge base whose folders and headings name none.

    ``k`` defaults to the square root of the documents, 2 to 8.  Classes are named by the order of their smallest document id, so
    a re-run gives the same names.
    """
    n = vectors.count()
    k = k or max(2, min(8, int(n**0.5)))
    d = cut_lineage(vectors.select(doc, array_to_vector(F.col(vec)).alias("features")))
    got = mlcl.KMeans(k=k, seed=0, maxIter=50).fit(d).transform(d).select(doc, "prediction")
    first = got.groupBy("prediction").agg(F.min(doc).alias("_first"))
    named = first.select("prediction", F.concat(F.lit("cluster_"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_first"))).alias(out))  # k rows
    return got.join(named, "prediction").select(doc, out)
