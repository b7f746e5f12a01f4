"""The operators bound to the given tables, each beside its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bitcodes, decontaminate, hard_negatives, jaccard, langid, lexical, licences, mixing, quality, sentencepiece, suffix_dedup, url_filter, warc
from .registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]

SQL_WORD = r"[^\x20\x09-\x0D]+"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_warc", """
with p as (select page_id, coalesce(strlen(html), 0) as n, sha1(coalesce(html, '')) as d, sha256(coalesce(html, '')) as s from pages),
f as (select s, max(page_id) as first from p where n >= 1000 group by s)
select page_id, n as payload_bytes, d as payload_digest, case when first <> page_id then 'revisit' else 'response' end as record_type,
case when first <> page_id then first end as refers_to from p left join f using (s)
""")
def op1_warc(spark, sf_dir):
    chunks = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return chunks.where("is_last").select(
        F.col("record_key").cast("bigint").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"))


OP3_SQL = f"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{SQL_WORD}')), 0)::bigint as size from documents),
per as (select source, sum(size)::bigint as source_size, [3.0, 1.0, 2.0][1 + ((row_number() over (order by source nulls last)) - 1) % 3]::double as w
  from d group by source),
run as (select *, row_number() over ratio as nth,
  (sum(source_size) over () * 1.5::double - coalesce(sum(source_size) over (ratio rows between unbounded preceding and 1 preceding), 0) * 2.0::double)
  / (sum(w) over () - coalesce(sum(w) over (ratio rows between unbounded preceding and 1 preceding), 0)) as level
  from per window ratio as (order by source_size / w, source nulls last)),
fit as (select arg_min(level, nth) as final from run where level * w < source_size * 2.0::double),
t as (select source, source_size, least(coalesce(final * w, source_size * 2.0::double), source_size * 2.0::double) as target from run, (select max(final) final from fit)),
e as (select doc_id, d.source, size, source_size, target, ('0x' || substr(md5(doc_id::varchar), 1, 3))::bigint as slice,
  case when source_size > 0 then floor(target / source_size * 16777216)::bigint else 0 end as e,
  ('0x' || substr(md5('mix|' || coalesce(d.source, '')), 1, 6))::bigint as o from d join t on d.source is not distinct from t.source),
s as (select *, o + sum(e) over (partition by source order by size, slice, doc_id rows unbounded preceding)::bigint as hi from e)
select doc_id, size, source_size, target, size * ((hi >> 24) - ((hi - e) >> 24)) as taken from s
"""


@query("op3_mix_sources", OP3_SQL)
def op3_mix_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix_sizes(docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op7_url_filter", url_filter.judge_sql())
def op7_url_filter(spark, sf_dir):
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


@query("op4_sentencepiece")
def op4_sentencepiece(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = sentencepiece.decode_pieces(sentencepiece.encode_pieces(docs))
    return done.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "score", "ids",
                       F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


@query("op2_language_id")
def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    profiles = langid.learn_held_out(docs.select("doc_id", "text", "lang"))
    found = langid.identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@query("op5_quality_rules")
def op5_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept")


@query("op8_license_scan")
def op8_license_scan(spark, sf_dir):
    found = licences.scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("sentence_ids").cast("bigint").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"),
                        F.array_join("licences", ",").alias("licences"), F.get("licences", F.lit(0)).alias("licence"))


@query("op10_bit_codes", """
with v as (select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
  and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e) as score from v q join v c on q.vec_id <> c.vec_id
  where q.vec_id % 20 = 0 and len(q.e) = len(c.e)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from p)
select query_id, rank, vec_id, score from r where rank <= 20
""")
def op10_bit_codes(spark, sf_dir):
    return bitcodes.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


@query("op9_jaccard_join")
def op9_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark, sf_dir):
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("bigint").alias("n_spans"), "kept_sha256")


SQL_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL_TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of a text in lower case


@query("op11_lexical_search", f"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all({SQL_LOWER}, '{SQL_TERM}') as t from documents),
n as (select rid, doc_id, len(t)::bigint as n from d where len(t) > 0),
whole as (select count(*)::bigint as docs, sum(n)::bigint as terms from n),
q as (select distinct item_id, unnest(regexp_extract_all({SQL_LOWER}, '{SQL_TERM}')) as term from benchmark where item_id is not null),
c as (select rid, term, count(*)::bigint as tf from (select rid, unnest(t) as term from d) where term in (select term from q) group by rid, term),
w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint as w from (select term, count(*) as df from c group by term), whole),
s as (select item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::bigint as score
  from q join c using (term) join w using (term) join n using (rid), whole where doc_id is not null group by item_id, rid, doc_id),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from s where score > 0)
select item_id, rank, doc_id, score from r where rank <= 10
""")
def op11_lexical_search(spark, sf_dir):
    return lexical.lexical_search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


@query("op12_hard_negatives", """
with v as (select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
  [floor(256 * x::double)::bigint for x in embedding] as e from embeddings where vec_id is not null and label is not null and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select a.vec_id as anchor_id, a.label as al, c.vec_id, c.label, list_sum([x[1] * x[2] for x in list_zip(a.e, c.e)])::bigint as score
  from v a join v c on a.vec_id <> c.vec_id and len(a.e) = len(c.e) where a.vec_id % 50 = 0),
pos as (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as r from p where label = al),
neg as (select pos.anchor_id, pos.vec_id as positive_id, p.vec_id as negative_id, pos.score as positive_score, p.score as negative_score,
  row_number() over (partition by pos.anchor_id, pos.vec_id order by p.score desc, p.vec_id)::int as rank
  from pos join p on pos.anchor_id = p.anchor_id and p.label <> p.al and 50 * pos.score <= 100 * p.score and 100 * p.score <= 95 * pos.score where r <= 5)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from neg where rank <= 3
""")
def op12_hard_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, moved)


@query("op13_decontaminate", f"""
with d as (select row_number() over () as rid, doc_id, coalesce(regexp_extract_all({SQL_LOWER}, '{SQL_TERM}'), []) as t from documents),
i as (select item_id, regexp_extract_all({SQL_LOWER}, '{SQL_TERM}') as t from benchmark where item_id is not null),
w as (select distinct item_id, least(10, len(t)) as n, array_to_string(t[s : s + least(10, len(t)) - 1], ' ') as seq
  from (select item_id, t, unnest(range(1, len(t) - least(10, len(t)) + 2)) as s from i where len(t) > 0)),
p as (select rid, s, n, array_to_string(t[s : s + n - 1], ' ') as seq from (select rid, t, n, unnest(range(1, len(t) - n + 2)) as s
  from d, (select distinct n from w))),
m as (select rid, s, n, item_id from p join w using (n, seq)),
hit as (select rid, count(distinct x)::bigint as n_hit from (select rid, unnest(range(s, s + n)) as x from m) group by rid),
its as (select rid, count(*)::bigint as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as items
  from (select distinct rid, item_id from m) group by rid)
select doc_id, len(t)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated from d left join hit using (rid) left join its using (rid)
""")
def op13_decontaminate(spark, sf_dir):
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(names, 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))
