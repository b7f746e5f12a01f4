"""N: counts, n-gram models, TF-IDF, lexicons, chunking and document refinement.

Terms live in long form (doc, term, tf): counts combine map-side, so a frequent term costs one row
per task, and no vocabulary is collected.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from ..functions.text import sentences, tokenize
from ..session import cut_lineage, drop_stored, stored
from .grams import _kind, count_grams, sentence_lists
from .ordering import quantiles
from .ranking import topk_by


def tokens_of(df, doc, text, pattern=r"[a-z_]{2,}") -> DataFrame:
    """(doc, tokens) with the default token pattern."""
    return df.select(doc, tokenize(text, pattern).alias("tokens"))


def term_counts(df, doc, tokens="tokens", keep=()) -> DataFrame:
    """(doc, term, tf)."""
    d = df.select(doc, *keep, F.explode(tokens).alias("term"))
    return d.groupBy(doc, *keep, "term").agg(F.count(F.lit(1)).alias("tf"))


def token_stats(df, tokens="tokens") -> DataFrame:
    """Tokens, types and their ratio."""
    g = df.select(F.explode(tokens).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.sum("n").alias("n_tokens"), F.count(F.lit(1)).alias("n_types")).withColumn(
        "type_share", F.col("n_types") / F.col("n_tokens"))


def unigrams(df, tokens="tokens", k=None) -> DataFrame:
    """Count and relative frequency per token, optionally the k most common."""
    g = df.select(F.explode(tokens).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    g = g.withColumn("freq", F.col("n") / g.agg(F.sum("n")).scalar())
    return g.orderBy(F.col("n").desc(), "term").limit(k) if k else g


def pad(tokens: Column, n: int) -> Column:
    """Sentence marks around a token array."""
    return F.concat(F.array(*[F.lit("<s>")] * (n - 1)), tokens, F.array(F.lit("</s>")))


def ngram_array(tokens: Column, n: int) -> Column:
    """All n-grams of an array as structs w1..wn: the array zipped with its own shifts, so the tokens
    are read n times and never once per position."""
    size = F.size(tokens)
    shifts = [F.slice(tokens, F.lit(i + 1), F.greatest(size - i, F.lit(0))).alias(f"w{i + 1}") for i in range(n)]
    return F.slice(F.arrays_zip(*shifts), F.lit(1), F.greatest(size - n + 1, F.lit(0)))


def sentence_tokens(df, doc, text, pattern=r"[a-z_]{2,}") -> DataFrame:
    """(doc, tokens) one row per sentence with at least one token."""
    s = df.select(doc, F.explode(sentences(text)).alias("s"))
    return s.select(doc, tokenize("s", pattern).alias("tokens")).where(F.size("tokens") > 0)


def ngrams(df, n, tokens="tokens", padded=True) -> DataFrame:
    """N-gram counts with columns w1..wn."""
    return count_grams(df, F.col(tokens), n, padded)


def sentence_ngrams(df, text, n) -> DataFrame:
    """N-gram counts of ``sentence_tokens``, with marks around each sentence."""
    return count_grams(df, F.col(text), n, read=sentence_lists)


def _conditional(grams, ctx) -> DataFrame:
    c = grams.groupBy(*ctx).agg(F.sum("n").alias("context_n"))
    return grams.join(c, ctx)


def bigram_mle(df, tokens="tokens") -> DataFrame:
    """count(w1,w2)/count(w1)."""
    return _conditional(ngrams(df, 2, tokens), ["w1"]).withColumn("p", F.col("n") / F.col("context_n"))


def vocabulary_size(df, tokens="tokens") -> Column:
    """Scalar number of types, the end mark included."""
    return df.select(F.explode(tokens).alias("t")).agg(F.countDistinct("t") + 1).scalar()


def bigram_laplace(df, tokens="tokens") -> DataFrame:
    """(count+1)/(count(w1)+V)."""
    d = _conditional(ngrams(df, 2, tokens), ["w1"])
    return d.withColumn("p", (F.col("n") + 1) / (F.col("context_n") + vocabulary_size(df, tokens)))


def trigram_mle(df, tokens="tokens") -> DataFrame:
    """count(w1,w2,w3)/count(w1,w2)."""
    return _conditional(ngrams(df, 3, tokens), ["w1", "w2"]).withColumn("p", F.col("n") / F.col("context_n"))


def predict_next(model, ctx=("w1",), nxt="w2") -> DataFrame:
    """Most frequent continuation per context, ties to the smaller word."""
    return model.groupBy(*ctx).agg(F.min_by(F.struct(nxt, "p"), F.struct(-F.col("n"), F.col(nxt))).alias("x")).select(
        *ctx, F.col(f"x.{nxt}").alias("prediction"), F.col("x.p").alias("p"))


def perplexity(test, train, doc, tokens="tokens") -> DataFrame:
    """Exp of the mean negative log probability under the Laplace bigram model of ``train``."""
    grams = ngrams(train, 2, tokens)
    ctx = grams.groupBy("w1").agg(F.sum("n").alias("context_n"))
    arr = pad(F.col(tokens), 2)
    t = test.select(doc, F.explode(ngram_array(arr, 2)).alias("g"))
    t = t.groupBy(doc, F.col("g.w1").alias("w1"), F.col("g.w2").alias("w2")).agg(F.count(F.lit(1)).alias("m"))
    j = t.join(grams, ["w1", "w2"], "left").join(ctx, "w1", "left").withColumn("_v", vocabulary_size(train, tokens))
    p = (F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("context_n", F.lit(0)) + F.col("_v"))
    return j.groupBy(doc).agg(F.exp(-F.sum(F.col("m") * F.ln(p)) / F.sum("m")).alias("perplexity"), F.sum("m").alias("n_grams"))


def document_frequency(tf, doc) -> DataFrame:
    """(term, df, total) from (doc, term, tf)."""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))


def bow(tf, doc, n_docs: Column, no_below=10, no_above=0.5, keep_n=None) -> DataFrame:
    """Counts over the dictionary: df >= no_below, df <= no_above*N, the keep_n most spread terms."""
    d = document_frequency(tf, doc).where((F.col("df") >= no_below) & (F.col("df") <= n_docs * no_above))
    if keep_n:
        d = d.orderBy(F.col("df").desc(), "term").limit(keep_n)
    return tf.join(d.select("term", "df"), "term")


def add_bigram_tokens(df, tokens="tokens") -> DataFrame:
    """Tokens plus their adjacent pairs, for 1-2-gram features."""
    two = F.transform(ngram_array(F.col(tokens), 2), lambda g: F.concat_ws(" ", g["w1"], g["w2"]))
    return df.withColumn(tokens, F.concat(tokens, two))


def tfidf(tf, doc, n_docs: Column, max_features=None) -> DataFrame:
    """Tf * (ln((1+N)/(1+df)) + 1), L2-normalised per document; optional cut to the most used terms."""
    d = document_frequency(tf, doc)
    if max_features:
        d = d.orderBy(F.col("total").desc(), "term").limit(max_features)
    w = tf.join(d.select("term", "df"), "term").withColumn("_w", F.col("tf") * (F.ln((n_docs + 1) / (F.col("df") + 1)) + 1))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(doc)))  # one document's terms
    return w.withColumn("weight", F.col("_w") / norm).drop("_w")


def _cells(docs: pa.Array, lists: pa.Array, pairs: bool):
    """(terms, row of ``docs`` first seen, document, term, count): the counted terms of a block, ordered by document."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    ids = docs.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
    first = np.unique(ids, return_index=True)[1]
    row = np.repeat(np.arange(len(ids)), sizes)
    words = lists.flatten().dictionary_encode()
    terms, code, own = words.dictionary, words.indices.to_numpy().astype(np.int64), ids[row]
    if pairs:
        inside = row[1:] == row[:-1]
        both, at = np.unique(code[:-1][inside] * max(1, len(terms)) + code[1:][inside], return_inverse=True)
        two = pc.binary_join_element_wise(terms.take(pa.array(both // max(1, len(terms)))), terms.take(pa.array(both % max(1, len(terms)))), " ")
        code, own = np.concatenate([code, at + len(terms)]), np.concatenate([own, ids[row[1:][inside]]])
        one = pa.concat_arrays([terms, two.cast(terms.type)]).dictionary_encode()  # a token may look like a pair
        terms, code = one.dictionary, one.indices.to_numpy().astype(np.int64)[code]
    cell, tf = np.unique(own * max(1, len(terms)) + code, return_counts=True)
    return terms, first, cell // max(1, len(terms)), cell % max(1, len(terms)), tf


def token_tfidf(df, doc, n_docs: Column, tokens="tokens", pairs=False, keep=(), rows: Column | None = None, block=2048) -> DataFrame:
    """(doc, *keep, term, tf, df, weight) from token lists; with ``pairs`` their adjacent pairs are terms as well.

    As ``tfidf``, but counts never travel: documents are dealt into blocks of about ``block`` by a hash, a block sends each of its
    terms once and gets the document frequency back for those that other blocks have too.  Of documents that ``rows`` leaves
    out only the terms are counted; the ``keep`` of a document's first row stands for all.
    """
    blocks = F.greatest(F.lit(1), F.ceil(n_docs / block)).cast("bigint")
    d = df.select(F.pmod(F.xxhash64(doc), blocks).alias("_block"), doc, *keep, F.col(tokens).alias("_t"), (F.lit(True) if rows is None else F.coalesce(rows, F.lit(False))).alias("_out"),
                  n_docs.cast("double").alias("_n"))

    def counted(batch: pa.Table) -> pa.Table:
        terms, _, _, term, _ = _cells(batch.column(doc).combine_chunks(), batch.column("_t").combine_chunks(), pairs)
        n = np.bincount(term, minlength=len(terms))
        return pa.table({"_block": pa.array(np.full(len(terms), batch.column("_block")[0].as_py())), "term": terms, "n": pa.array(n)})

    sent = d.groupBy("_block").applyInArrow(counted, "_block bigint, term string, n bigint")
    every = sent.withColumn("_all", F.sum("n").over(Window.partitionBy("term")))  # one row per block
    back = every.where("_all <> n").select("_block", "term", "_all")

    def weigh(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({c: pa.array([], t) for c, t in [(doc, left.schema.field(doc).type), *[(c, left.schema.field(c).type) for c in keep]]}
                            | {"term": pa.array([], pa.string()), "tf": pa.array([], pa.int64()), "df": pa.array([], pa.int64()), "weight": pa.array([], pa.float64())})
        terms, first, own, term, tf = _cells(left.column(doc).combine_chunks(), left.column("_t").combine_chunks(), pairs)
        seen = np.bincount(term, minlength=len(terms))
        if right.num_rows:
            at = pc.index_in(right.column("term").combine_chunks().cast(terms.type), value_set=terms).to_numpy()
            seen[at] = right.column("_all").to_numpy()
        wanted = left.column("_out").combine_chunks().take(pa.array(first)).to_numpy(zero_copy_only=False).astype(bool)[own]
        own, term, tf = own[wanted], term[wanted], tf[wanted]
        w = tf * (np.log((left.column("_n")[0].as_py() + 1) / (seen[term] + 1)) + 1)
        norm = np.sqrt(np.bincount(own, w * w, minlength=len(first)))
        of = pa.array(first[own])
        return pa.table({c: left.column(c).combine_chunks().take(of) for c in (doc, *keep)}
                        | {"term": terms.take(pa.array(term)), "tf": pa.array(tf.astype(np.int64)), "df": pa.array(seen[term].astype(np.int64)), "weight": pa.array(w / norm[own])})

    schema = T.StructType([T.StructField(c, d.schema[c].dataType) for c in (doc, *keep)])
    for c, kind in [("term", T.StringType()), ("tf", T.LongType()), ("df", T.LongType()), ("weight", T.DoubleType())]:
        schema = schema.add(c, kind)
    return d.groupBy("_block").cogroup(back.groupBy("_block")).applyInArrow(weigh, schema)


def presence_features(tf, doc, n) -> DataFrame:
    """Which of the n most used terms occur in each document."""
    top = document_frequency(tf, doc).orderBy(F.col("total").desc(), "term").limit(n)
    return tf.join(top.select("term"), "term").select(doc, "term")


def naive_bayes(tf, doc, label, alpha=1.0) -> DataFrame:
    """Multinomial model as rows (label, term, log_p); a null term holds the class prior and the
    log probability of an unseen term as ``log_unseen``."""
    g = tf.groupBy(label, "term").agg(F.sum("tf").alias("n"))
    v = tf.select("term").distinct().agg(F.count(F.lit(1))).scalar()
    docs = tf.select(label, doc).distinct().groupBy(label).agg(F.count(F.lit(1)).alias("docs"))
    return _multinomial(g, v, docs, label, alpha)


def _multinomial(g, v: Column, docs, label, alpha) -> DataFrame:
    tot = g.groupBy(label).agg(F.sum("n").alias("total"))
    n_docs = docs.agg(F.sum("docs")).scalar()
    m = g.join(tot, label).select(label, "term", F.ln((F.col("n") + alpha) / (F.col("total") + alpha * v)).alias("log_p"))
    prior = tot.join(docs, label).select(
        label, F.lit(None).cast("string").alias("term"), F.ln(F.col("docs") / n_docs).alias("log_p"),
        F.ln(alpha / (F.col("total") + alpha * v)).alias("log_unseen"))
    return m.withColumn("log_unseen", F.lit(None).cast("double")).unionByName(prior)


def naive_bayes_tokens(df, doc, label, tokens: Column, alpha=1.0) -> DataFrame:
    """``naive_bayes`` from token lists: counts combine before they travel, and they are stored once."""
    g = stored(df.select(label, F.explode(tokens).alias("term")).groupBy(label, "term").agg(F.count(F.lit(1)).alias("n")))
    docs = stored(df.where(F.size(tokens) > 0).select(label, doc).distinct().groupBy(label).agg(F.count(F.lit(1)).alias("docs")))
    return _multinomial(g, g.select("term").distinct().agg(F.count(F.lit(1))).scalar(), docs, label, alpha)


def naive_bayes_predict(model, tf, doc, label) -> DataFrame:
    """Class with the largest log posterior per document."""
    prior = model.where("term IS NULL").select(label, F.col("log_p").alias("_prior"), F.col("log_unseen").alias("_un"))
    known = model.where("term IS NOT NULL").select(label, "term", "log_p")
    # gain over the unseen level for known terms; the level itself needs only the document length
    un = model.where("term IS NULL").select(label, F.col("log_unseen").alias("_u"))
    gain = tf.join(known.join(un, label), "term").groupBy(doc, label).agg(
        F.sum(F.col("tf") * (F.col("log_p") - F.col("_u"))).alias("_gain"))
    vocab = known.select("term").distinct()
    size = tf.join(vocab, "term", "left_semi").groupBy(doc).agg(F.sum("tf").alias("_len"))
    classes = prior.agg(F.sort_array(F.collect_list(F.struct(label, "_prior", "_un")))).scalar()  # one entry per class
    s = size.withColumn("_c", F.explode(classes)).select(doc, "_len", "_c.*").join(gain, [doc, label], "left")
    score = F.col("_prior") + F.col("_len") * F.col("_un") + F.coalesce("_gain", F.lit(0.0))
    return s.groupBy(doc).agg(F.max_by(label, F.struct(score, F.col(label))).alias("prediction"), F.max(score).alias("log_posterior"))


def naive_bayes_predict_tokens(model, df, doc, label, tokens: Column, load: Column) -> DataFrame:
    """``naive_bayes_predict`` from token lists: a block of documents is counted once, sends each of its terms once and gets their
    log probabilities back.  ``load`` is about how many terms a document has; it sizes the blocks, which are met group by group."""
    from .factor import CELLS, GROUP, _read, count_cells

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))  # rows hold whole blocks
    classes = sorted((r[label], r["log_p"], r["log_unseen"]) for r in model.where("term IS NULL").collect())  # one row per class
    of = {c: i for i, (c, _, _) in enumerate(classes)}
    prior, unseen = (np.array([c[i] for c in classes]) for i in (1, 2))
    known = stored(model.where("term IS NOT NULL").groupBy("term").agg(F.collect_list(F.struct(F.col(label).alias("_label"), "log_p")).alias("_p")))  # an entry per class
    known = known.select("term", F.transform("_p", lambda x: x["_label"]).alias("_labels"), F.transform("_p", lambda x: x["log_p"]).alias("_logs"))
    blocks = max(1, int(-(-(df.agg(F.sum(load.cast("double"))).first()[0] or 0) // CELLS)))
    groups = -(-blocks // GROUP)
    counted = count_cells(df, doc, tokens, blocks, groups)
    schema = T.StructType([df.schema[doc], T.StructField("prediction", model.schema[label].dataType), T.StructField("log_posterior", T.DoubleType())])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        docs = left["docs"].combine_chunks().flatten()
        kind = right.schema.field("_labels").type.value_type
        if not left.num_rows or not right.num_rows:
            return pa.table({doc: docs[:0], "prediction": pa.array([], kind), "log_posterior": pa.array([], pa.float64())})
        r = left.select(["ends", "cols", "n", "kind"]).to_pylist()[0]
        count = len(left["terms"].combine_chunks().flatten())
        ends, cols, n = _read(r, "ends", np.int64), _read(r, "cols", _kind(count)), _read(r, "n", r["kind"]).astype(float)
        own, at = np.repeat(np.arange(len(docs)), np.diff(ends)), right["_i"].to_numpy()
        logs, there = np.zeros((count, len(of))), np.zeros(count)
        logs[at], there[at] = unseen, 1
        lists = right["_labels"].combine_chunks()
        flat = lists.flatten().dictionary_encode()
        codes = np.array([of[x] for x in flat.dictionary.to_pylist()], np.int64)[flat.indices.to_numpy()]
        logs[np.repeat(at, pc.list_value_length(lists).to_numpy()), codes] = right["_logs"].combine_chunks().flatten().to_numpy()
        some = np.flatnonzero(np.bincount(own, there[cols], len(docs)))
        s = np.stack([p + np.bincount(own, n * logs[cols, c], len(docs)) for c, p in enumerate(prior)])[:, some]
        best = len(of) - 1 - np.argmax(s[::-1], axis=0)  # ties to the larger label
        return pa.table({doc: docs.take(pa.array(some)), "prediction": pa.array([c[0] for c in classes], kind).take(pa.array(best)), "log_posterior": pa.array(s.max(0))})

    made = []
    for g in range(groups):
        part = counted.where(F.col("_g") == g)
        asked = part.select(F.col("_b").alias("_at"), F.posexplode("terms").alias("_i", "term")).join(known, "term").drop("term")
        left, right = part.drop("_g", "seen").repartition(min(2 * GROUP, 2 * blocks), "_b"), asked.repartition(min(2 * GROUP, 2 * blocks), "_at")
        made.append(stored(left.groupBy("_b").cogroup(right.groupBy("_at")).applyInArrow(score, schema)))
    drop_stored(counted)
    return reduce(DataFrame.unionByName, made)


def bernoulli_nb(tf, doc, label, alpha=1.0) -> DataFrame:
    """Bernoulli model as rows (label, term, gain): the log odds of a term's presence against those of a term that the class
    lacks.  A null term holds ``level`` (class prior and log probability of an empty document) and ``odds`` of a lacking term."""
    g = cut_lineage(tf.select(label, doc, "term").distinct().groupBy(label, "term").agg(F.count(F.lit(1)).alias("n")))
    docs = cut_lineage(tf.select(label, doc).distinct().groupBy(label).agg(F.count(F.lit(1)).alias("docs")))
    v, n_docs = g.select("term").distinct().agg(F.count(F.lit(1))).scalar(), docs.agg(F.sum("docs")).scalar()
    p, p0 = (F.col("n") + alpha) / (F.col("docs") + 2 * alpha), F.lit(alpha) / (F.col("docs") + 2 * alpha)
    d = g.join(docs, label)
    odds = lambda x: F.ln(x / (1 - x))
    none = F.lit(None).cast("double")
    m = d.select(label, "term", (odds(p) - odds(p0)).alias("gain"), none.alias("level"), none.alias("odds"))
    base = d.groupBy(label, "docs").agg((F.sum(F.ln(1 - p) - F.ln(1 - p0)) + v * F.ln(1 - F.first(p0))).alias("empty"))
    return m.unionByName(base.select(
        label, F.lit(None).cast("string").alias("term"), none.alias("gain"), (F.ln(F.col("docs") / n_docs) + F.col("empty")).alias("level"), odds(p0).alias("odds")))


def bernoulli_nb_predict(model, tf, doc, label) -> DataFrame:
    """Class with the largest log posterior per document, from the presence of known terms."""
    known = model.where("term IS NOT NULL").select(label, "term", "gain")
    terms = tf.select(doc, "term").distinct()
    gain = terms.join(known, "term").groupBy(doc, label).agg(F.sum("gain").alias("_gain"))
    size = terms.join(known.select("term").distinct(), "term", "left_semi").groupBy(doc).agg(F.count(F.lit(1)).alias("_len"))
    classes = model.where("term IS NULL").agg(F.sort_array(F.collect_list(F.struct(label, "level", "odds")))).scalar()  # one entry per class
    s = size.withColumn("_c", F.explode(classes)).select(doc, "_len", "_c.*").join(gain, [doc, label], "left")
    score = F.col("level") + F.col("_len") * F.col("odds") + F.coalesce("_gain", F.lit(0.0))
    return s.groupBy(doc).agg(F.max_by(label, F.struct(score, F.col(label))).alias("prediction"), F.max(score).alias("log_posterior"))


def bernoulli_nb_predict_tokens(model, df, doc, label, n_docs: Column, tokens="tokens", block=2048) -> DataFrame:
    """``bernoulli_nb_predict`` from token lists: a block of documents sends each of its terms once and gets their gains back."""
    known = model.where("term IS NOT NULL").select("term", F.col(label).alias("_label"), "gain")
    classes = model.where("term IS NULL").agg(F.sort_array(F.collect_list(F.struct(label, "level", "odds")))).scalar()  # one entry per class
    blocks = F.greatest(F.lit(1), F.ceil(n_docs / block)).cast("bigint")
    d = df.select(F.pmod(F.xxhash64(doc), blocks).alias("_block"), doc, F.col(tokens).alias("_t"))

    def terms_of(batch: pa.Table) -> pa.Table:
        terms = pc.unique(pc.list_flatten(batch.column("_t").combine_chunks()))
        return pa.table({"_block": pa.array(np.full(len(terms), batch.column("_block")[0].as_py())), "term": terms})

    back = d.groupBy("_block").applyInArrow(terms_of, "_block bigint, term string").join(known, "term")
    back = back.groupBy("_block", "term").agg(F.sort_array(F.collect_list(F.struct("_label", "gain"))).alias("_gains"))  # an entry per class
    back = back.select("_block", "term", F.transform("_gains", lambda x: x["_label"]).alias("_labels"), F.transform("_gains", lambda x: x["gain"]).alias("_gains"))

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = {doc: left.schema.field(doc).type, "_len": pa.int64(), "_label": right.schema.field("_labels").type.value_type, "_gain": pa.float64()}
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], t) for c, t in kinds.items()})
        docs = left.column(doc).combine_chunks()
        terms, first, own, term, _ = _cells(docs, left.column("_t").combine_chunks(), False)
        at = pc.index_in(right.column("term").combine_chunks().cast(terms.type), value_set=terms).to_numpy()
        lists = right.column("_gains").combine_chunks()
        each = np.repeat(at, pc.list_value_length(lists).to_numpy())
        labels = right.column("_labels").combine_chunks().flatten().dictionary_encode()
        gain = np.zeros((len(terms), len(labels.dictionary)))
        gain[each, labels.indices.to_numpy()] = lists.flatten().to_numpy()
        there = np.zeros(len(terms))
        there[at] = 1
        size = np.bincount(own, there[term], minlength=len(first)).astype(np.int64)
        some = np.flatnonzero(size)
        out = [pa.table({doc: docs.take(pa.array(first[some])), "_len": pa.array(size[some]), "_label": labels.dictionary.take(pa.array(np.full(len(some), c))),
                         "_gain": pa.array(np.bincount(own, gain[term, c], minlength=len(first))[some])}) for c in range(len(labels.dictionary))]
        return pa.concat_tables(out)

    schema = T.StructType([d.schema[doc], T.StructField("_len", T.LongType()), T.StructField("_label", model.schema[label].dataType), T.StructField("_gain", T.DoubleType())])
    got = d.groupBy("_block").cogroup(back.groupBy("_block")).applyInArrow(add, schema)
    per = got.groupBy(doc).agg(F.max("_len").alias("_len"), F.collect_list(F.struct("_label", "_gain")).alias("_gains"))  # an entry per class
    s = per.withColumn("_c", F.explode(classes)).select(doc, "_len", "_gains", "_c.*")
    gain = F.coalesce(F.get(F.filter("_gains", lambda x: x["_label"] == F.col(label)), F.lit(0))["_gain"], F.lit(0.0))
    s = s.select(doc, label, (F.col("level") + F.col("_len") * F.col("odds") + gain).alias("_s"))
    return s.groupBy(doc).agg(F.max_by(label, F.struct("_s", label)).alias("prediction"), F.max("_s").alias("log_posterior"))


def informative_terms(tf, doc, label, a, b, k, alpha=0.5) -> DataFrame:
    """Terms with the largest ratio of presence rates between two classes."""
    n = tf.select(label, doc).distinct().groupBy().agg(
        F.sum((F.col(label) == a).cast("int")).alias("na"), F.sum((F.col(label) == b).cast("int")).alias("nb"))
    na, nb = n.agg(F.max("na")).scalar(), n.agg(F.max("nb")).scalar()
    g = tf.groupBy("term").agg(F.sum((F.col(label) == a).cast("int")).alias("a"), F.sum((F.col(label) == b).cast("int")).alias("b"))
    ra, rb = (F.col("a") + alpha) / (na + 2 * alpha), (F.col("b") + alpha) / (nb + 2 * alpha)
    g = g.withColumn("ratio", F.greatest(ra / rb, rb / ra))
    return g.orderBy(F.round("ratio", 9).desc(), "term").limit(k)


def lexicon_score(tf, doc, lexicon, threshold=0.0) -> DataFrame:
    """Summed valence, its positive and negative parts, and a label by threshold."""
    v = F.col("tf") * F.col("valence")
    g = tf.join(lexicon.select("term", "valence"), "term").groupBy(doc).agg(
        F.sum(v).alias("score"), F.sum(F.when(v > 0, v).otherwise(0.0)).alias("positive"),
        F.sum(F.when(v < 0, -v).otherwise(0.0)).alias("negative"))
    lab = F.when(F.col("score") > threshold, "positive").when(F.col("score") < -threshold, "negative").otherwise("neutral")
    return g.withColumn("label", lab)


def rating_label(c) -> Column:
    """>=4 positive, 3 neutral, <=2 negative."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c >= 4, "positive").when(c <= 2, "negative").when(c == 3, "neutral")


def agreement(df, a, b) -> DataFrame:
    """Cross table of two labels with the share of each cell."""
    g = df.groupBy(F.col(a).alias("label_a"), F.col(b).alias("label_b")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / df.agg(F.count(F.lit(1))).scalar())


def umass(tf, doc, topics) -> DataFrame:
    """Mean ln((D(wi,wj)+1)/max(1,D(wj))) over word pairs of each topic.

    ``topics`` has (topic, rank, term), rank 0 the weakest of the top words; wj precedes wi.
    Only topic words are joined, so a document carries at most topics*words rows.
    """
    words = tf.join(topics.select("term").distinct(), "term", "left_semi").select(doc, "term").distinct()
    d1 = words.groupBy("term").agg(F.count(F.lit(1)).alias("dj"))
    lists = words.groupBy(doc).agg(F.sort_array(F.collect_list("term")).alias("ts"))
    i = lists.select("ts", F.posexplode("ts").alias("p", "x"))
    co = i.select("x", F.explode(F.slice("ts", F.col("p") + 2, F.size("ts"))).alias("y")).groupBy("x", "y").agg(F.count(F.lit(1)).alias("dij"))
    a, b = topics.alias("a"), topics.alias("b")
    pr = a.join(b, (F.col("a.topic") == F.col("b.topic")) & (F.col("b.rank") < F.col("a.rank"))).select(
        F.col("a.topic").alias("topic"), F.least("a.term", "b.term").alias("x"), F.greatest("a.term", "b.term").alias("y"),
        F.col("b.term").alias("term"))
    j = pr.join(co, ["x", "y"], "left").join(d1, "term", "left")
    val = F.ln((F.coalesce("dij", F.lit(0)) + 1) / F.greatest(F.lit(1), F.coalesce("dj", F.lit(0))))
    return j.groupBy("topic").agg(F.avg(val).alias("coherence"))


# ---- chunking --------------------------------------------------------------------------------

_HEADING = r"^\s{0,3}#{1,6}\s+\S+"


def _n_tokens(c: Column) -> Column:
    return F.size(tokenize(c))


def _heading_only(c: Column) -> Column:
    return F.forall(F.split(c, "\n"), lambda l: (F.trim(l) == "") | l.rlike(_HEADING))


def chunk_markdown(df, doc, text, max_tokens=400) -> DataFrame:
    """Heading-anchored chunks: paragraphs are packed up to ``max_tokens`` inside a section, a chunk
    of headings only is merged into the one before.

    A section starts at a heading that follows body text.  Folds run over one document's blocks and
    paragraphs.
    """
    t = F.regexp_replace(F.col(text), r"\r\n?", "\n")
    blocks = F.filter(F.split(t, r"\n(?=[ ]{0,3}#{1,6}[ \t]+\S)"), lambda b: F.trim(b) != "")
    none = F.array().cast("array<string>")
    sections = F.aggregate(
        blocks, none,
        lambda acc, b: F.when((F.size(acc) > 0) & _heading_only(F.element_at(acc, -1)),
                              F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit("\n"), b))))
        .otherwise(F.concat(acc, F.array(b))))
    d = df.select(doc, F.posexplode(sections).alias("section", "_s"))
    w = Window.partitionBy(doc).orderBy("section").rowsBetween(Window.unboundedPreceding, 0)  # one document
    own = F.transform(F.regexp_extract_all("_s", F.lit(r"(?m)^\s{0,3}#{1,6}\s+(\S.*?)\s*$"), F.lit(1)), lambda h: F.trim(h))
    d = d.withColumn("headings", F.flatten(F.collect_list(own).over(w)))
    paras = F.filter(F.transform(F.split("_s", r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"^\s+|\s+$", ""))), lambda p: p != "")
    sized = F.transform(paras, lambda p: F.struct(p.alias("p"), _n_tokens(p).alias("n")))
    start = F.struct(none.alias("done"), F.lit("").alias("cur"), F.lit(0).alias("n"))

    def pack(acc, x):
        full = (acc["cur"] != "") & (acc["n"] + x["n"] > max_tokens)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"),
            F.when(full | (acc["cur"] == ""), x["p"]).otherwise(F.concat(acc["cur"], F.lit("\n\n"), x["p"])).alias("cur"),
            F.when(full, x["n"]).otherwise(acc["n"] + x["n"]).alias("n"))

    packed = F.aggregate(sized, start, pack, lambda a: F.when(a["cur"] != "", F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]))
    d = d.select(doc, "section", "headings", F.posexplode(packed).alias("part", "chunk_text"))
    d = d.withColumn("_ho", _heading_only(F.col("chunk_text")).cast("int"))
    # a chunk of headings joins the chunk before it; the first chunk of a document stays
    wd = Window.partitionBy(doc).orderBy("section", "part")
    d = d.withColumn("_g", F.sum(F.when((F.col("_ho") == 0) | (F.row_number().over(wd) == 1), 1).otherwise(0)).over(wd))
    g = d.groupBy(doc, "_g").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section", "part", "chunk_text"))), lambda x: x["chunk_text"]), "\n").alias("chunk_text"),
        F.min_by("headings", F.struct("section", "part")).alias("headings"))
    return g.select(
        doc, (F.col("_g") - 1).alias("chunk_no"), "chunk_text", "headings", _n_tokens(F.col("chunk_text")).alias("token_count"),
        F.length("chunk_text").alias("char_count"), _heading_only(F.col("chunk_text")).cast("int").alias("heading_only"))


def chunk_overlap(df, doc, text, max_tokens=400, overlap=50) -> DataFrame:
    """Sliding windows of ``max_tokens`` words with ``overlap`` words carried over, per headed block.

    Headings without body are put in front of the next block's heading; a trailing one is its own chunk.
    """
    t = F.regexp_replace(F.col(text), r"\r\n?", "\n")
    blocks = F.split(t, r"\n(?=\s*#{1,6}\s+)")
    part = F.transform(blocks, lambda b: F.struct(
        F.trim(F.regexp_extract(b, r"^\s*#{1,6}\s+(.*)", 1)).alias("h"),
        F.trim(F.regexp_replace(F.regexp_replace(b, r"^\s*#{1,6}\s+.*", ""), r"\s+", " ")).alias("b")))
    start = F.struct(F.array().cast("array<struct<h:string,b:string>>").alias("out"), F.lit("").alias("pend"))

    def step(acc, x):
        full = F.when(acc["pend"] == "", x["h"]).when(x["h"] == "", acc["pend"]).otherwise(F.concat(acc["pend"], F.lit(" / "), x["h"]))
        empty = x["b"] == ""
        return F.struct(
            F.when(empty, acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(full.alias("h"), x["b"].alias("b"))))).alias("out"),
            F.when(empty, full).otherwise("").alias("pend"))

    done = F.aggregate(part, start, step, lambda a: F.when(
        a["pend"] != "", F.concat(a["out"], F.array(F.struct(a["pend"].alias("h"), F.lit("").alias("b"))))).otherwise(a["out"]))
    d = df.select(doc, F.posexplode(done).alias("block", "_b")).select(doc, "block", F.col("_b.h").alias("heading"), F.col("_b.b").alias("_t"))
    words = F.filter(F.split(F.concat_ws(" ", "heading", "_t"), r"\s+"), lambda x: x != "")
    d = d.withColumn("_w", words).where(F.size("_w") > 0)
    step_n = max(1, max_tokens - overlap)
    # window i >= 1 exists while new words remain after the first max_tokens
    last = F.greatest(F.lit(0), F.ceil((F.size("_w") - max_tokens) / F.lit(step_n)))
    d = d.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    win = F.slice(F.col("_w"), (F.col("part") * step_n + 1).cast("int"), max_tokens)
    return d.select(doc, "block", "part", "heading", F.array_join(win, " ").alias("chunk_text"), F.size(win).alias("n_tokens"))


def chunk_quality(chunks, n="token_count", by=()) -> DataFrame:
    """Chunks, exact median tokens, share below 50 tokens, heading-only chunks."""
    by = list(by)
    g = chunks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(n) < 50).cast("int")).alias("share_short"),
        F.sum("heading_only").alias("heading_only"))
    q = quantiles(chunks, n, [0.5], by, ["median_tokens"])
    return g.join(q, by) if by else g.withColumn("median_tokens", q.agg(F.max("median_tokens")).scalar())


def chunk_ablation(df, doc, text, sizes) -> DataFrame:
    """The quality table for several chunk sizes."""
    parts = [chunk_markdown(df, doc, text, s).withColumn("max_tokens", F.lit(s)) for s in sizes]
    return chunk_quality(reduce(DataFrame.unionByName, parts), by=["max_tokens"])


def derive_taxonomy(df, rules: list[str], fallback=None, out="class_label") -> DataFrame:
    """Label from the first column with at least two distinct values, else from ``fallback(df)``."""
    n = df.agg(*[F.countDistinct(F.when(F.col(c) != "", F.col(c))).alias(c) for c in rules]).first()
    for c in rules:
        if n[c] >= 2:
            return df.withColumn(out, F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit("unlabelled")))
    return fallback(df) if fallback else df.withColumn(out, F.lit("all"))


# ---- document refinement ----------------------------------------------------------------------


def refine_docs(df, doc, text, title) -> DataFrame:
    """Normalised markdown with the number of H1 before and the list of actions taken.

    Outside code fences: setext headings become ATX, a space follows the marks, a second H1 becomes H2;
    a missing H1 is inserted from ``title``; more than two blank lines in a row are cut.
    """
    t = F.regexp_replace(F.col(text), r"\r\n?", "\n")
    h1 = F.regexp_replace(t, r"(?m)^[ \t]*(\S.*?)[ \t]*\n[ \t]*={3,}[ \t]*$", "# $1")
    h2 = F.regexp_replace(h1, r"(?m)^[ \t]*([^\s\-#>|].*?)[ \t]*\n[ \t]*-{3,}[ \t]*$", "## $1")
    d = df.withColumns({"_t": t, "_h1": h1, "_h2": h2})
    lines = F.transform(F.split("_h2", "\n"), lambda l: F.rtrim(F.regexp_replace(l, r"\s+$", "")))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("fence"), F.lit(0).alias("h1"), F.lit(0).alias("spaced"))

    def step(acc, l):
        mark = F.trim(l).startswith("```")
        open_ = ~acc["fence"] & ~mark
        tight = open_ & l.rlike(r"^#{1,6}[^#\s]")
        s = F.when(tight, F.regexp_replace(l, r"^(#{1,6})\s*(.*)$", "$1 $2")).otherwise(l)
        is_h1 = open_ & s.rlike(r"^#\s+\S")
        s = F.when(is_h1 & (acc["h1"] > 0), F.concat(F.lit("#"), s)).otherwise(s)
        return F.struct(
            F.concat(acc["out"], F.array(s)).alias("out"), F.when(mark, ~acc["fence"]).otherwise(acc["fence"]).alias("fence"),
            (acc["h1"] + is_h1.cast("int")).alias("h1"), (acc["spaced"] + tight.cast("int")).alias("spaced"))

    d = d.withColumn("_st", F.aggregate(lines, start, step))
    joined = F.array_join("_st.out", "\n")
    with_h1 = F.when(F.col("_st.h1") == 0, F.concat(F.lit("# "), F.col(title), F.lit("\n\n"), joined)).otherwise(joined)
    d = d.withColumn("_j", with_h1)
    cut = F.regexp_replace("_j", r"\n{4,}", "\n\n\n")
    actions = F.sort_array(F.array_compact(F.array(
        F.when(F.col("_t") != F.col("_h1"), "converted_setext_h1"), F.when(F.col("_h1") != F.col("_h2"), "converted_setext_h2"),
        F.when(F.col("_st.spaced") > 0, "normalized_heading_spacing"), F.when(F.col("_st.h1") > 1, "demoted_extra_h1"),
        F.when(F.col("_st.h1") == 0, "inserted_missing_h1"), F.when(F.col("_j") != cut, "trimmed_extra_blank_lines"))))
    return d.select(
        doc, F.concat(F.regexp_replace(cut, r"^\s+|\s+$", ""), F.lit("\n")).alias("refined"), F.col("_st.h1").alias("h1_count_before"),
        actions.alias("actions"))


# fixed values: patterns counted in refined documents
_COUNTS = {
    "heading_count": r"(?m)^#{1,6}\s+\S+", "h1_count_after": r"(?m)^#\s+\S+", "h2_count_after": r"(?m)^##\s+\S+",
    "table_line_count": r"(?m)^\s*\|", "code_fence_count": r"(?m)^```",
    "email_count": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "url_count": r"https?://\S+",
    "windows_user_path_count": r"[A-Za-z]:\\Users\\[^\\\s]+", "word_count": r"[A-Za-z0-9_]+",
}


def doc_flags(refined, doc) -> DataFrame:
    """Counts, title and quality flags of refined documents."""
    d = refined.withColumns({n: F.regexp_count("refined", F.lit(p)) for n, p in _COUNTS.items()})
    d = d.withColumns({"title": F.trim(F.regexp_extract("refined", r"(?m)^#\s+(.+)$", 1)), "char_count": F.length("refined")})
    c = F.col
    flags = F.sort_array(F.array_compact(F.array(
        F.when(c("word_count") < 50, "short_doc_under_50_words"), F.when(c("h1_count_before") == 0, "missing_h1_before_refine"),
        F.when(c("h1_count_before") > 1, "multiple_h1_before_refine"), F.when(c("h2_count_after") == 0, "no_h2_after_refine"),
        F.when(c("code_fence_count") % 2 == 1, "unbalanced_code_fence"), F.when(c("table_line_count") > 0, "contains_markdown_table"),
        F.when(c("email_count") > 0, "contains_email"), F.when(c("windows_user_path_count") > 0, "contains_windows_user_path"),
        F.when((c("heading_count") <= 1) & (c("word_count") > 200), "long_doc_without_subheadings"))))
    return d.select(doc, "title", "char_count", *_COUNTS, "h1_count_before", flags.alias("flags"), "actions")


def flag_summary(flags) -> DataFrame:
    """Documents per flag and per action."""
    both = F.concat(F.transform("flags", lambda x: F.struct(F.lit("flag").alias("kind"), x.alias("name"))),
                    F.transform("actions", lambda x: F.struct(F.lit("action").alias("kind"), x.alias("name"))))
    return flags.select(F.explode(both).alias("x")).select("x.*").groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))


def filter_short(df, tokens="tokens", min_tokens=3, text=None, min_chars=0) -> DataFrame:
    """Texts with enough tokens and characters."""
    d = df.where(F.size(tokens) >= min_tokens)
    return d.where(F.length(text) >= min_chars) if text else d


def class_keywords(weights, doc, label, n) -> DataFrame:
    """Terms with the largest mean weight per class (absent terms count as 0)."""
    size = weights.select(label, doc).distinct().groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    g = weights.groupBy(label, "term").agg(F.sum("weight").alias("_s")).join(size, label)
    g = g.select(label, "term", F.round(F.col("_s") / F.col("_n"), 9).alias("score"))
    return topk_by(g, label, "score", "term", n)
