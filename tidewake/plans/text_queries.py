"""N queries on documents, benchmark, conversations and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as s, text as tx
from ..operators import retrieval as rt, textops as n
from ..session import cut_lineage, stored
from .registry import query
from .trades import r

TOK = "regexp_extract_all(lower(text), '[a-z_]{2,}')"
TF_SQL = f"tk AS (SELECT doc_id, unnest({TOK}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM tk GROUP BY ALL)"
QF_SQL = f"qk AS (SELECT item_id, unnest({TOK}) AS term FROM benchmark), qf AS (SELECT item_id, term, count(*) AS tf FROM qk GROUP BY ALL)"
NDOC = "(SELECT count(*) FROM documents)"


def toks(t):
    return n.tokens_of(t.documents, "doc_id", "text")


def tf(t):
    return n.term_counts(toks(t), "doc_id").cache()  # stands for a stored term table


def qf(t):
    return n.term_counts(n.tokens_of(t.benchmark, "item_id", "text"), "item_id")


def n_docs(t):
    return t.documents.agg(F.count(F.lit(1))).scalar()


def labelled_tf(t):
    d = toks(t).join(t.labels.select("doc_id", "quality"), "doc_id")
    return n.term_counts(d, "doc_id", keep=["quality"])


LTF_SQL = f"{TF_SQL}, ltf AS (SELECT doc_id, quality, term, tf FROM tf JOIN labels USING (doc_id))"


@query("N01_token_stats", f"WITH {TF_SQL} SELECT count(*) AS n_tokens, count(DISTINCT term) AS n_types, round(count(DISTINCT term) / count(*)::DOUBLE, 6) AS type_share FROM tk")
def _(t):
    return r(n.token_stats(toks(t)), "type_share")


@query("N02_unigrams", f"WITH {TF_SQL} SELECT term, count(*) AS n, round(count(*) / (SELECT count(*) FROM tk)::DOUBLE, 9) AS freq FROM tk GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def _(t):
    return r(n.unigrams(toks(t), k=50), "freq", digits=9)


def pad_sql(k, marks=1):
    pre = "[" + ", ".join(["'<s>'"] * marks) + "]"
    cols = ", ".join(f"p[i + {j}] AS w{j + 1}" for j in range(k))
    return f"""pd AS (SELECT doc_id, list_concat(list_concat({pre}, {TOK}), ['</s>']) AS p FROM documents), g{k} AS (SELECT {cols}, count(*) AS n FROM (SELECT p, unnest(generate_series(1, len(p) - {k - 1})) AS i FROM pd) GROUP BY ALL)"""


@query("N03_ngrams", f"WITH {pad_sql(3, 2)} SELECT w1, w2, w3, n FROM g3")
def _(t):
    return n.ngrams(toks(t), 3)


SENT_SQL = r"""s0 AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+')) AS s FROM documents),
  sn AS (SELECT ['<s>', '<s>', '<s>'] || regexp_extract_all(lower(s), '[a-z_]{2,}') || ['</s>'] AS w FROM s0 WHERE len(regexp_extract_all(lower(s), '[a-z_]{2,}')) > 0)"""


@query("N03b_sentence_ngrams", f"""WITH {SENT_SQL}, p AS (SELECT w, unnest(generate_series(1, len(w) - 3)) AS i FROM sn)
  SELECT w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3, w[i + 3] AS w4, count(*) AS n FROM p GROUP BY ALL""")
def _(t):
    return n.sentence_ngrams(t.documents, "text", 4)


@query("N04_bigram_mle", f"WITH {pad_sql(2)} SELECT w1, w2, n, sum(n) OVER (PARTITION BY w1)::BIGINT AS context_n, round(n / (sum(n) OVER (PARTITION BY w1))::DOUBLE, 6) AS p FROM g2")
def _(t):
    return r(n.bigram_mle(toks(t)), "p")


@query("N05_bigram_laplace", f"WITH {pad_sql(2)}, {TF_SQL}, v AS (SELECT count(DISTINCT term) + 1 AS v FROM tk) SELECT w1, w2, n, sum(n) OVER (PARTITION BY w1)::BIGINT AS context_n, round((n + 1) / (sum(n) OVER (PARTITION BY w1) + v)::DOUBLE, 9) AS p FROM g2, v")
def _(t):
    return r(n.bigram_laplace(toks(t)), "p", digits=9)


@query("N06_trigram_mle", f"WITH {pad_sql(3, 2)} SELECT w1, w2, w3, n, sum(n) OVER (PARTITION BY w1, w2)::BIGINT AS context_n, round(n / (sum(n) OVER (PARTITION BY w1, w2))::DOUBLE, 6) AS p FROM g3")
def _(t):
    return r(n.trigram_mle(toks(t)), "p")


@query("N07_predict_next", f"WITH {pad_sql(2)}, m AS (SELECT *, n / (sum(n) OVER (PARTITION BY w1))::DOUBLE AS p FROM g2) SELECT w1, w2 AS prediction, round(p, 6) AS p FROM m QUALIFY row_number() OVER (PARTITION BY w1 ORDER BY n DESC, w2) = 1")
def _(t):
    return r(n.predict_next(n.bigram_mle(toks(t))), "p")


@query("N08_perplexity", f"""WITH {pad_sql(2)}, {TF_SQL}, v AS (SELECT count(DISTINCT term) + 1 AS v FROM tk), c AS (SELECT w1, sum(n) AS cn FROM g2 GROUP BY 1),
  qp AS (SELECT item_id, list_concat(list_concat(['<s>'], {TOK}), ['</s>']) AS p FROM benchmark), q AS (SELECT item_id, p[i] AS w1, p[i + 1] AS w2 FROM (SELECT item_id, p, unnest(generate_series(1, len(p) - 1)) AS i FROM qp))
  SELECT item_id, round(exp(-avg(ln((coalesce(n, 0) + 1) / (coalesce(cn, 0) + v)::DOUBLE))), 4) AS perplexity, count(*) AS n_grams FROM q LEFT JOIN g2 USING (w1, w2) LEFT JOIN c USING (w1), v GROUP BY 1""")
def _(t):
    return r(n.perplexity(n.tokens_of(t.benchmark, "item_id", "text"), toks(t), "item_id"), "perplexity", digits=4)


BOW = f"WITH {TF_SQL}, d AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1), v AS (SELECT * FROM d WHERE df >= 10 AND df <= 0.5 * {NDOC})"


@query("N09_bow", f"{BOW} SELECT doc_id, term, tf, df FROM tf JOIN v USING (term)")
def _(t):
    return n.bow(tf(t), "doc_id", n_docs(t), 10, 0.5)


TFIDF = f"""{LTF_SQL}, d AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1), v AS (SELECT * FROM d),
  w AS (SELECT doc_id, term, tf, df, tf * (ln((1 + {NDOC}) / (1 + df)::DOUBLE) + 1) AS w FROM tf JOIN v USING (term)), x AS (SELECT doc_id, term, tf, df, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w)"""


@query("N10_tfidf", f"WITH {TFIDF} SELECT doc_id, term, tf, df, round(weight, 6) AS weight FROM x")
def _(t):
    return r(n.tfidf(tf(t), "doc_id", n_docs(t)), "weight")


BG_SQL = f"""g0 AS (SELECT doc_id, {TOK} AS w FROM documents), gk AS (SELECT doc_id, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) AS term FROM g0),
  gt AS (SELECT doc_id, term, count(*) AS tf FROM gk GROUP BY ALL), gd AS (SELECT term, count(*) AS df FROM gt GROUP BY 1), gw AS (SELECT doc_id, term, tf, df, tf * (ln((1 + {NDOC}) / (1 + df)::DOUBLE) + 1) AS w FROM gt JOIN gd USING (term))"""


@query("N10b_tfidf_bigrams", f"WITH {BG_SQL} SELECT doc_id, term, tf, df, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM gw")
def _(t):
    return r(n.token_tfidf(toks(t), "doc_id", n_docs(t), pairs=True), "weight")


@query("N11_presence_features", f"WITH {TFIDF}, top AS (SELECT term FROM d ORDER BY total DESC, term LIMIT 100) SELECT doc_id, term FROM tf JOIN top USING (term)")
def _(t):
    return n.presence_features(tf(t), "doc_id", 100)


NB = f"""WITH {LTF_SQL}, g AS (SELECT quality, term, sum(tf) AS n FROM ltf GROUP BY ALL), v AS (SELECT count(DISTINCT term) AS v FROM ltf), tt AS (SELECT quality, sum(n) AS total FROM g GROUP BY 1),
  dc AS (SELECT quality, count(DISTINCT doc_id) AS docs FROM ltf GROUP BY 1), cl AS (SELECT quality, total, ln(docs / (SELECT sum(docs) FROM dc)::DOUBLE) AS prior, ln(1 / (total + v)::DOUBLE) AS un FROM tt JOIN dc USING (quality), v)"""


@query("N12_naive_bayes", f"{NB} SELECT quality, term, round(ln((n + 1) / (total + v)::DOUBLE), 6) AS log_p, NULL::DOUBLE AS log_unseen FROM g JOIN tt USING (quality), v UNION ALL SELECT quality, NULL, round(prior, 6), round(un, 6) FROM cl")
def _(t):
    return r(n.naive_bayes(labelled_tf(t), "doc_id", "quality"), "log_p", "log_unseen")


@query("N12b_naive_bayes_predict", f"""{NB}, vo AS (SELECT DISTINCT term FROM g), p AS (SELECT t.doc_id, c.quality, c.prior + sum(t.tf * coalesce(ln((g.n + 1) / (c.total + v)::DOUBLE), c.un)) AS s
  FROM (SELECT * FROM tf WHERE term IN (SELECT term FROM vo)) t CROSS JOIN cl c CROSS JOIN v LEFT JOIN g ON g.term = t.term AND g.quality = c.quality GROUP BY t.doc_id, c.quality, c.prior)
  SELECT doc_id, arg_max(quality, s) AS prediction, round(max(s), 3) AS log_posterior FROM p GROUP BY 1""")
def _(t):
    d, words = t.documents.select("doc_id", "text"), tx.tokenize("text", r"[a-z_]{2,}")
    m = n.naive_bayes_tokens(d.join(t.labels.select("doc_id", "quality"), "doc_id"), "doc_id", "quality", words)
    return r(n.naive_bayes_predict_tokens(m, d, "doc_id", "quality", words, F.length("text") / 12), "log_posterior", digits=3)


@query("N12d_bernoulli_nb", f"""WITH {LTF_SQL}, g AS (SELECT quality, term, count(DISTINCT doc_id) AS n FROM ltf GROUP BY ALL), dc AS (SELECT quality, count(DISTINCT doc_id)::DOUBLE AS docs FROM ltf GROUP BY 1),
  vc AS (SELECT DISTINCT term FROM ltf), q AS (SELECT dc.quality, vc.term, (coalesce(n, 0) + 1) / (docs + 2) AS p FROM dc CROSS JOIN vc LEFT JOIN g ON g.quality = dc.quality AND g.term = vc.term),
  base AS (SELECT quality, sum(ln(1 - p)) AS empty FROM q GROUP BY 1), pres AS (SELECT doc_id, quality, sum(ln(p / (1 - p))) AS gain FROM tf JOIN q USING (term) GROUP BY ALL),
  s AS (SELECT doc_id, quality, ln(docs / (SELECT sum(docs) FROM dc)) + empty + gain AS score FROM pres JOIN base USING (quality) JOIN dc USING (quality))
  SELECT doc_id, arg_max(quality, score) AS prediction, round(max(score), 3) AS log_posterior FROM s GROUP BY doc_id""")
def _(t):
    m = n.bernoulli_nb(labelled_tf(t), "doc_id", "quality")
    return r(n.bernoulli_nb_predict_tokens(m, toks(t), "doc_id", "quality", n_docs(t)), "log_posterior", digits=3)


@query("N12c_informative_terms", f"""WITH {LTF_SQL}, m AS (SELECT count(DISTINCT doc_id) FILTER (quality = 1) AS na, count(DISTINCT doc_id) FILTER (quality = 0) AS nb FROM ltf), g AS (SELECT term, count(*) FILTER (quality = 1) AS a, count(*) FILTER (quality = 0) AS b FROM ltf GROUP BY 1)
  SELECT term, a, b, round(ratio, 6) AS ratio FROM (SELECT term, a, b, greatest(((a + 0.5) / (na + 1)) / ((b + 0.5) / (nb + 1)), ((b + 0.5) / (nb + 1)) / ((a + 0.5) / (na + 1)))::DOUBLE AS ratio FROM g, m) ORDER BY round(ratio, 9) DESC, term LIMIT 30""".replace("0.5", "0.5::DOUBLE"))
def _(t):
    return r(n.informative_terms(labelled_tf(t), "doc_id", "quality", 1, 0, 30), "ratio")


LEX_SQL = f"lx AS (SELECT term, floor((('0x' || substr(md5(term || ':0'), 1, 12))::BIGINT / 281474976710656::DOUBLE) * 9) - 4 AS valence FROM (SELECT term, count(*) AS c FROM tk GROUP BY 1) WHERE c >= 50)"


def lexicon(t):
    u = n.unigrams(toks(t)).where("n >= 50")
    return u.select("term", (F.floor(s.unit_hash("term") * 9) - 4).cast("double").alias("valence"))


SC_SQL = f"{TF_SQL}, {LEX_SQL}, sc AS (SELECT doc_id, sum(tf * valence) AS score, sum(greatest(tf * valence, 0)) AS positive, sum(greatest(-tf * valence, 0)) AS negative FROM tf JOIN lx USING (term) GROUP BY 1), lb AS (SELECT *, CASE WHEN score > 5 THEN 'positive' WHEN score < -5 THEN 'negative' ELSE 'neutral' END AS label FROM sc)"


@query("N13_lexicon_score", f"WITH {SC_SQL} SELECT doc_id, score, label FROM lb")
def _(t):
    return n.lexicon_score(tf(t), "doc_id", lexicon(t), 5.0).select("doc_id", "score", "label")


@query("N14_lexicon_posneg", f"WITH {SC_SQL} SELECT doc_id, positive, negative, round(positive - negative, 6) AS net FROM lb")
def _(t):
    d = n.lexicon_score(tf(t), "doc_id", lexicon(t), 5.0)
    return d.select("doc_id", "positive", "negative", F.round(F.col("positive") - F.col("negative"), 6).alias("net"))


@query("N15_rating_label", "SELECT l_linenumber, CASE WHEN l_linenumber >= 4 THEN 'positive' WHEN l_linenumber <= 2 THEN 'negative' ELSE 'neutral' END AS label, count(*) AS n FROM lineitem GROUP BY ALL")
def _(t):
    return t.lineitem.groupBy("l_linenumber", n.rating_label("l_linenumber").alias("label")).agg(F.count("*").alias("n"))


@query("N16_agreement", f"WITH {SC_SQL}, j AS (SELECT label, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS q FROM lb JOIN labels USING (doc_id)) SELECT label AS label_a, q AS label_b, count(*) AS n, round(count(*) / (SELECT count(*) FROM j)::DOUBLE, 6) AS share FROM j GROUP BY ALL")
def _(t):
    d = n.lexicon_score(tf(t), "doc_id", lexicon(t), 5.0).join(t.labels, "doc_id").withColumn("q", F.when(F.col("quality") == 1, "good").otherwise("bad"))
    return r(n.agreement(d, "label", "q"), "share")


TOPICS = [(0, i, w) for i, w in enumerate("the and of to in".split())] + [(1, i, w) for i, w in enumerate("der die und das zu".split())]
TOPICS_SQL = "tp(topic, rank, term) AS (VALUES " + ", ".join(f"({a}, {b}, '{c}')" for a, b, c in TOPICS) + ")"


@query("N18_umass", f"""WITH {TF_SQL}, {TOPICS_SQL}, pr AS (SELECT a.topic, a.term AS wi, b.term AS wj FROM tp a JOIN tp b ON a.topic = b.topic AND b.rank < a.rank),
  x AS (SELECT topic, wi, wj, (SELECT count(*) FROM tf p JOIN tf q USING (doc_id) WHERE p.term = wi AND q.term = wj) AS dij, (SELECT count(*) FROM tf p WHERE p.term = wj) AS dj FROM pr) SELECT topic, round(avg(ln((dij + 1) / greatest(1, dj)::DOUBLE)), 6) AS coherence FROM x GROUP BY 1""")
def _(t):
    tp = t.spark.createDataFrame(TOPICS, "topic int, rank int, term string")
    return r(n.umass(tf(t), "doc_id", tp), "coherence")


def markdown(t):
    """The documents as markdown: a title, and a heading in front of every line of prose."""
    body = F.regexp_replace("text", "\n", "\n\n## Section\n\n")
    return t.documents.select("doc_id", "source", F.concat(F.lit("Doc "), "doc_id", F.lit("\n=====\n\n"), body).alias("text"))


@query("N20_chunk_markdown")
def _(t):
    md = t.documents.select("doc_id", F.concat(F.lit("# Doc "), "doc_id", F.lit("\n\n"), F.regexp_replace("text", "\n", "\n\n## Section\n\n")).alias("text"))
    d = n.chunk_markdown(md, "doc_id", "text", 60)
    return d.select("doc_id", "chunk_no", F.md5("chunk_text").alias("digest"), F.size("headings").alias("n_headings"), "token_count", "char_count", "heading_only")


@query("N21_chunk_overlap", r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
  p AS (SELECT doc_id, w, unnest(generate_series(0, greatest(0, ceil((len(w) - 100) / 80.0)::BIGINT))) AS part FROM w WHERE len(w) > 0)
  SELECT doc_id, part, md5(array_to_string(w[part * 80 + 1 : part * 80 + 100], ' ')) AS digest, len(w[part * 80 + 1 : part * 80 + 100])::INTEGER AS n_tokens FROM p""")
def _(t):
    d = n.chunk_overlap(t.documents, "doc_id", "text", 100, 20)
    return d.select("doc_id", "part", F.md5("chunk_text").alias("digest"), "n_tokens")


@query("N22_chunk_quality")
def _(t):
    return r(n.chunk_ablation(markdown(t), "doc_id", "text", [50, 100]), "share_short")


@query("N23_derive_taxonomy", "SELECT source AS class_label, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    d = n.derive_taxonomy(t.documents.withColumn("folder", F.lit("")), ["folder", "source", "lang"])
    return d.groupBy("class_label").agg(F.count("*").alias("n"))


@query("N24_refine_docs")
def _(t):
    d = n.refine_docs(markdown(t), "doc_id", "text", "source")
    return d.select("doc_id", F.md5("refined").alias("digest"), "h1_count_before", F.array_join("actions", ",").alias("actions"))


@query("N24b_doc_flags")
def _(t):
    d = n.doc_flags(n.refine_docs(markdown(t), "doc_id", "text", "source"), "doc_id")
    return d.withColumns({"flags": F.array_join("flags", ","), "actions": F.array_join("actions", ",")})


@query("N24c_flag_summary")
def _(t):
    return n.flag_summary(n.doc_flags(n.refine_docs(markdown(t), "doc_id", "text", "source"), "doc_id"))


KW_SQL = f"{TFIDF}, lw AS (SELECT quality, doc_id, term, weight FROM x JOIN labels USING (doc_id)), sz AS (SELECT quality, count(DISTINCT doc_id) AS n FROM lw GROUP BY 1), ks AS (SELECT quality, term, round(sum(weight) / any_value(n), 9) AS score FROM lw JOIN sz USING (quality) GROUP BY ALL), kw AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY score DESC, term) AS rank FROM ks QUALIFY rank <= 30)"


def keywords(t):
    own = t.labels.groupBy("doc_id").agg(F.collect_list("quality").alias("quality"))  # one document's labels
    w = n.token_tfidf(toks(t).join(own, "doc_id", "left"), "doc_id", n_docs(t), keep=["quality"], rows=F.size("quality") > 0)
    w = w.withColumn("quality", F.explode("quality"))
    return cut_lineage(n.class_keywords(w, "doc_id", "quality", 30))  # 30 rows per class


def keyword_terms(t, k):
    """(doc_id, term) of the keywords in each document, found in its own tokens."""
    return rt.keyword_terms(toks(t), "doc_id", "tokens", k)


@query("N25_class_keywords", f"WITH {KW_SQL} SELECT quality, term, round(score, 6) AS score, rank FROM kw")
def _(t):
    return r(keywords(t), "score")


@query("N26_keyword_route", f"""WITH {KW_SQL}, h AS (SELECT doc_id, quality AS route, count(*) AS m FROM tf JOIN kw USING (term) GROUP BY ALL), b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY m DESC, route) = 1)
  SELECT d.doc_id, coalesce(route::VARCHAR, 'unmatched') AS route, coalesce(m, 0)::BIGINT AS matched FROM documents d LEFT JOIN b USING (doc_id)""")
def _(t):
    k = keywords(t).withColumn("quality", F.col("quality").cast("string"))
    return rt.keyword_route(keyword_terms(t, k), "doc_id", k, "quality", t.documents)


CURVE_SQL = f"""{KW_SQL}, h AS (SELECT doc_id, labels.quality AS y, kw.quality AS route, n, count(*) AS m FROM tf JOIN kw USING (term) JOIN labels USING (doc_id), (SELECT unnest(generate_series(3, 30)) AS n) WHERE rank <= n GROUP BY ALL),
  b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY doc_id, n ORDER BY m DESC, route) = 1), p AS (SELECT n, route, avg((route = y)::INTEGER) AS p FROM b GROUP BY ALL), cv AS (SELECT n::INTEGER AS n, round(sum(p) / 2, 6) AS precision_macro FROM p GROUP BY 1)"""


@query("N26b_precision_curve", f"WITH {CURVE_SQL} SELECT n, precision_macro FROM cv")
def _(t):
    k = keywords(t)
    return r(rt.precision_curve(keyword_terms(t, k), "doc_id", k, "quality", t.labels, "quality", list(range(3, 31))), "precision_macro")


@query("N26c_keyword_elbow", f"WITH {CURVE_SQL}, gn AS (SELECT *, precision_macro - coalesce(lag(precision_macro) OVER (ORDER BY n), 0) AS g FROM cv) SELECT coalesce(min(n) FILTER (WHERE g <= 0.01), arg_max(n, precision_macro)) AS keyword_n FROM gn")
def _(t):
    k = keywords(t)
    return rt.elbow(rt.precision_curve(keyword_terms(t, k), "doc_id", k, "quality", t.labels, "quality", list(range(3, 31))))


CEN = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT label, i, avg(v[i]) AS m FROM (SELECT label, v, unnest(generate_series(1, len(v))) AS i FROM e) GROUP BY ALL), c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY 1),
  sm AS (SELECT vec_id, e.label AS own, c.label, list_cosine_similarity(v, c) AS s FROM e, c)"""


@query("N27_centroids", f"WITH {CEN}, nm AS (SELECT label, sqrt(sum(m * m)) AS z FROM m GROUP BY 1) SELECT label, i::INTEGER AS i, round(m / z, 6) AS x FROM m JOIN nm USING (label)")
def _(t):
    d = rt.centroids(t.embeddings, "label", "embedding").select("label", F.posexplode("centroid").alias("i", "x"))
    return d.select("label", (F.col("i") + 1).alias("i"), F.round("x", 6).alias("x"))


@query("N27b_assign", f"WITH {CEN} SELECT vec_id, label, round(s, 6) AS score FROM sm QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) = 1")
def _(t):
    c = rt.centroids(t.embeddings, "label", "embedding")
    d = rt.assign(t.embeddings, "vec_id", "embedding", c, "label")
    return d.select("vec_id", F.col("label").cast("int").alias("label"), F.round("score", 6).alias("score"))


@query("N27c_membership", f"WITH {CEN} SELECT vec_id, label, round(s, 6) AS score FROM sm WHERE s >= 0.25 OR own = label")
def _(t):
    c = rt.centroids(t.embeddings, "label", "embedding")
    d = rt.membership(t.embeddings, "vec_id", "embedding", "label", c, "label", 10)
    return d.select("vec_id", F.col("label").cast("int").alias("label"), F.round("score", 6).alias("score"))


@query("N28_align_topics", f"""WITH {CEN}, g AS (SELECT vec_id, max(s) AS best, arg_max(label, s) AS bc, sum((s >= 0.3)::INTEGER)::BIGINT AS nm FROM sm GROUP BY 1)
  SELECT vec_id, round(best, 6) AS best, bc AS best_class, nm AS n_multi, CASE WHEN best >= 0.5 AND nm <= 1 THEN 'single' WHEN nm >= 2 THEN 'multi' WHEN best >= 0.5 THEN 'single' ELSE 'gap' END AS decision FROM g""")
def _(t):
    c = rt.centroids(t.embeddings, "label", "embedding")
    d = rt.align_topics(t.embeddings, "vec_id", "embedding", c, "label", "centroid", 10, 0.5, 0.3)
    return r(d.withColumn("best_class", F.col("best_class").cast("int")), "best")


@query("N29_dense_topk", """WITH s AS (SELECT a.vec_id AS q_id, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label)
  SELECT q_id, vec_id, round(s, 6) AS score, row_number() OVER (PARTITION BY q_id ORDER BY s DESC, vec_id) AS rank FROM s QUALIFY rank <= 5""")
def _(t):
    q = t.embeddings.select(F.col("vec_id").alias("q_id"), "embedding", "label")
    return r(rt.dense_topk(q, t.embeddings, "q_id", "vec_id", "embedding", 5, "label"), "score").select("q_id", "vec_id", "score", "rank")


BM_SQL = f"""{TF_SQL}, {QF_SQL}, df0 AS (SELECT term, ln(({NDOC} - count(*) + 0.5) / (count(*) + 0.5)::DOUBLE) AS i0 FROM tf GROUP BY 1), idf AS (SELECT term, CASE WHEN i0 < 0 THEN 0.25 * (SELECT avg(i0) FROM df0) ELSE i0 END AS idf FROM df0),
  dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY 1), bm AS (SELECT item_id, doc_id, round(sum(qf.tf * idf * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * dl / ((SELECT sum(dl) FROM dl) / {NDOC}::DOUBLE)))), 9) AS score FROM qf JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (doc_id) GROUP BY ALL),
  bt AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM bm QUALIFY rank <= 20)"""


class Retrieval:
    """Term tables, index and ranked lists of one query, each built and stored once."""

    def __init__(self, t):
        self.n, self.documents = n_docs(t), t.documents
        self.qf = cut_lineage(qf(t))
        self.wanted = self.qf.select("term").distinct()
        self.counted = rt.count_index(toks(t), "doc_id", "tokens", self.n)
        self.df = stored(rt.frequencies(self.counted))

    def bm25(self, k=20):
        return cut_lineage(rt.search_index(rt.bm25_counts(self.counted, self.df, self.wanted, self.n), self.qf, "item_id", "doc_id", k))

    def lexical(self, ranked):
        found = F.broadcast(ranked.select("doc_id").distinct())  # the few best of each query
        tf = cut_lineage(n.term_counts(n.tokens_of(self.documents.join(found, "doc_id", "left_semi"), "doc_id", "text"), "doc_id"))
        return cut_lineage(rt.rerank_lexical(ranked, self.qf, tf, "item_id", "doc_id", self.n, 10, self.df))

    def gold(self):
        """The document with the most matched terms."""
        one = self.qf.select("item_id", "term", F.lit(1).alias("tf"))
        return rt.search_index(rt.match_counts(self.counted, self.wanted), one, "item_id", "doc_id", 1).select("item_id", "doc_id")


@query("N30_bm25_topk", f"WITH {BM_SQL} SELECT item_id, doc_id, round(score, 5) AS score, rank FROM bt")
def _(t):
    return r(Retrieval(t).bm25(), "score", digits=5).select("item_id", "doc_id", "score", "rank")


LEXR_SQL = f"""{BM_SQL}, ti AS (SELECT term, ln((1 + {NDOC}) / (1 + count(*))::DOUBLE) + 1 AS w FROM tf GROUP BY 1), dw AS (SELECT doc_id, term, tf * w / sqrt(sum(tf * w * tf * w) OVER (PARTITION BY doc_id)) AS w FROM tf JOIN ti USING (term)),
  qw AS (SELECT item_id, term, tf * w / sqrt(sum(tf * w * tf * w) OVER (PARTITION BY item_id)) AS w FROM qf JOIN ti USING (term)), lr AS (SELECT item_id, doc_id, round(sum(qw.w * dw.w), 9) AS score FROM bt JOIN qw USING (item_id) JOIN dw USING (doc_id, term) GROUP BY ALL),
  lk AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM lr QUALIFY rank <= 10)"""


@query("N32_rerank_lexical", f"WITH {LEXR_SQL} SELECT item_id, doc_id, round(score, 6) AS score, rank FROM lk")
def _(t):
    parts = Retrieval(t)
    return r(parts.lexical(parts.bm25()), "score").select("item_id", "doc_id", "score", "rank")


@query("N31_rrf", f"WITH {LEXR_SQL}, f AS (SELECT item_id, doc_id, round(sum(1 / (60 + rank)::DOUBLE), 12) AS score FROM (SELECT item_id, doc_id, rank FROM bt UNION ALL SELECT item_id, doc_id, rank FROM lk) GROUP BY ALL) SELECT item_id, doc_id, round(score, 9) AS score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 10")
def _(t):
    parts = Retrieval(t)
    first = parts.bm25()
    return r(rt.rrf([first, parts.lexical(first)], "item_id", "doc_id", 10), "score", digits=9).select("item_id", "doc_id", "score", "rank")


GOLD_SQL = "gd AS (SELECT item_id, doc_id FROM (SELECT item_id, doc_id, count(*) AS c FROM qf JOIN tf USING (term) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY c DESC, doc_id) = 1)"


@query("N33_retrieval_at_k", f"""WITH {LEXR_SQL}, {GOLD_SQL}, rk AS (SELECT 'bm25' AS arch, item_id, doc_id, rank FROM bt UNION ALL SELECT 'lexical', item_id, doc_id, rank FROM lk), h AS (SELECT arch, item_id, min(rank) AS r FROM rk JOIN gd USING (item_id, doc_id) GROUP BY ALL)
  SELECT arch, k, round(avg((coalesce(r, 1000) <= k)::INTEGER), 6) AS hit_rate, count(*) AS n FROM gd CROSS JOIN (VALUES ('bm25'), ('lexical')) a(arch) CROSS JOIN (VALUES (1), (5), (10)) z(k) LEFT JOIN h USING (arch, item_id) GROUP BY ALL""")
def _(t):
    parts = Retrieval(t)
    first = parts.bm25()
    rk = first.withColumn("arch", F.lit("bm25")).unionByName(parts.lexical(first).withColumn("arch", F.lit("lexical")))
    d = rt.retrieval_at_k(rk, parts.gold(), "item_id", "doc_id", [1, 5, 10])
    return r(d.select("arch", "k", "hit_rate", "n"), "hit_rate")


@query("N33b_retrieval_interval")
def _(t):
    parts = Retrieval(t)
    rk = parts.bm25().withColumn("arch", F.lit("bm25"))
    return r(rt.retrieval_at_k(rk, parts.gold(), "item_id", "doc_id", [1, 5, 10]), "hit_rate", "lo", "hi")


def arch_parts(t):
    q = t.embeddings.select(F.col("vec_id").alias("q_id"), "embedding")
    c = t.embeddings.select("vec_id", "embedding", F.col("label").cast("bigint").alias("label"))
    cents = rt.centroids(t.embeddings, "label", "embedding")
    scored = rt._nearest(q, "q_id", "embedding", cents, "label", 10)
    return q, c, scored


ROUTE_SQL = f"""{CEN}, rk AS (SELECT vec_id AS q_id, label, s, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS rank FROM sm),
  rl AS (SELECT vec_id AS q_id FROM e JOIN events ON vec_id = event_id GROUP BY 1 HAVING max(value) > 100),
  mc AS (SELECT *, max((s >= 0.35)::INTEGER) OVER (PARTITION BY q_id) AS one FROM rk),
  cls AS (SELECT 'A' AS arch, q_id, label FROM rk WHERE rank = 1 UNION ALL SELECT 'B', q_id, 0 FROM rl UNION ALL SELECT 'B', q_id, label FROM rk WHERE rank = 1 AND q_id NOT IN (SELECT q_id FROM rl)
    UNION ALL SELECT 'C', q_id, label FROM mc WHERE s >= 0.35 OR (one = 0 AND rank <= 2) UNION ALL SELECT 'F', q_id, label FROM rk WHERE rank <= 2),
  cand AS (SELECT arch, q_id, b.vec_id, list_cosine_similarity(x.v, b.v) AS s FROM cls JOIN e x ON x.vec_id = q_id JOIN e b ON b.label = cls.label
    UNION ALL SELECT 'D', x.vec_id, b.vec_id, list_cosine_similarity(x.v, b.v) FROM e x, e b)"""


@query("N34_route_architectures", f"WITH {ROUTE_SQL} SELECT arch, q_id, vec_id, round(s, 6) AS score, row_number() OVER (PARTITION BY arch, q_id ORDER BY s DESC, vec_id) AS rank FROM cand QUALIFY rank <= 3")
def _(t):
    q, c, scored = arch_parts(t)
    one, two = scored.where("rank = 1").select("q_id", "label"), scored.where("rank <= 2").select("q_id", "label")
    many = rt.multi_label(scored.withColumn("p", F.col("score")), "q_id", "label")
    rules = q.join(t.events.groupBy(F.col("event_id").alias("q_id")).agg(F.max("value").alias("v")).where("v > 100"), "q_id").select("q_id", F.lit(0).cast("bigint").alias("label"))
    parts = [rt.route("A", q, c, "q_id", "vec_id", "embedding", "label", 3, one), rt.route("B", q, c, "q_id", "vec_id", "embedding", "label", 3, one, rules),
             rt.route("C", q, c, "q_id", "vec_id", "embedding", "label", 3, many), rt.route("D", q, c, "q_id", "vec_id", "embedding", "label", 3),
             rt.route("F", q, c, "q_id", "vec_id", "embedding", "label", 3, two)]
    from functools import reduce
    return r(reduce(lambda a, b: a.unionByName(b), parts), "score")


@query("N34b_route_top_class", f"""WITH {CEN}, a AS (SELECT vec_id AS q_id, label FROM sm QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) = 1)
  SELECT q_id, b.vec_id, round(list_cosine_similarity(x.v, b.v), 6) AS score, row_number() OVER (PARTITION BY q_id ORDER BY list_cosine_similarity(x.v, b.v) DESC, b.vec_id) AS rank FROM a JOIN e x ON x.vec_id = q_id JOIN e b ON b.label = a.label QUALIFY rank <= 3""")
def _(t):
    q, c, scored = arch_parts(t)
    d = rt.route("A", q, c, "q_id", "vec_id", "embedding", "label", 3, scored.where("rank = 1").select("q_id", "label"))
    return r(d.drop("arch"), "score")


HYBRID_SQL = f"""{BM_SQL}, ve AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), dn AS (SELECT q.vec_id AS item_id, c.vec_id AS doc_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, c.v), 12) DESC, c.vec_id) AS rank
    FROM ve q JOIN benchmark ON q.vec_id = item_id, ve c QUALIFY rank <= 20),
  fs AS (SELECT item_id, doc_id, round(sum(1 / (60 + rank)::DOUBLE), 12) AS score FROM (SELECT item_id, doc_id, rank FROM bt UNION ALL SELECT item_id, doc_id, rank FROM dn) GROUP BY ALL)"""


@query("N34c_hybrid", f"WITH {HYBRID_SQL} SELECT item_id, doc_id, round(score, 9) AS score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM fs WHERE item_id IN (SELECT vec_id FROM ve) QUALIFY rank <= 20")
def _(t):
    sparse = Retrieval(t).bm25()
    c = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    q = t.embeddings.join(t.benchmark, F.col("vec_id") == F.col("item_id")).select("item_id", "embedding")
    d = rt.route("D", q, c, "item_id", "doc_id", "embedding", None, 20, sparse=sparse.join(q.select("item_id"), "item_id", "left_semi"))
    return r(d, "score", digits=9).select("item_id", "doc_id", "score", "rank")


@query("N35_flag_access_request", r"SELECT role, sum(regexp_matches(text, '(?i)\b(change[\s_]?request|CR[-\s]?\d+|access\s+(to|for)|role\s+access|request(ing)?\s+access)\b')::INTEGER)::BIGINT AS flagged, count(*) AS n FROM (SELECT role, text || CASE WHEN turn % 5 = 0 THEN ' Requesting access to it' ELSE '' END AS text FROM conversations) GROUP BY 1")
def _(t):
    d = t.conversations.withColumn("text", F.concat("text", F.when(F.col("turn") % 5 == 0, " Requesting access to it").otherwise("")))
    return d.groupBy("role").agg(F.sum(tx.access_request("text")).alias("flagged"), F.count("*").alias("n"))


@query("N36_filter_short", f"SELECT conv_id, turn FROM conversations WHERE len({TOK}) >= 20 AND length(text) >= 150")
def _(t):
    d = t.conversations.withColumn("tokens", tx.tokenize("text"))
    return n.filter_short(d, "tokens", 20, "text", 150).select("conv_id", "turn")
