"""From raw documents to piece ids: five stages, each written as Parquet and read again as the next one's input.

1. *Language ID*: profiles are learned from the labelled documents that are not held out; documents without a letter, or whose
   score is below ``MIN_SCORE`` (no profile fits), go.  A null language is filled in.  If nothing could be learned, all stay.
2. *Near duplicates* (n-gram Jaccard join): of each component the document with the smallest id stays, once.
3. *Suffix-array dedup*: byte strings of 100 that start earlier go from the texts; a text that lost all it had goes.
4. *Mixing*: documents are repeated or left out so that sources come near their target weights.
5. *SentencePiece*: texts become piece ids, decoded again as a check.

Nulls: a null text has no letter and goes in stage 1; rows with a null id are never near duplicates of others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewake.llm import jaccard, langid, mixing, sentencepiece, suffix_dedup
from tidewake.llm.common import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIN_SCORE = 0.25
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    profiles = langid.learn_held_out(docs.select("doc_id", "text", "lang"))
    found = langid.identify(docs.select(*COLUMNS), profiles)
    if profiles:
        found = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SCORE))
        found = found.withColumn("lang", F.coalesce("lang", "lang_pred"))
    return found.select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = jaccard.jaccard_components(docs.select("doc_id", "text"))
    first = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = docs.select(*COLUMNS).join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])  # repeated rows have one id
    return kept.select(*COLUMNS).union(docs.where("doc_id is null").select(*COLUMNS))


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(docs.select(*COLUMNS))
    cut = cut.where((F.col("n_removed") == 0) | (F.trim("kept_text") != ""))
    return cut.withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept_text"))).withColumn(
        "n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("bigint"))).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(docs.select(*COLUMNS)).where("copies > 0")
    return mixed.select(*COLUMNS, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = sentencepiece.decode_pieces(sentencepiece.encode_pieces(docs.select("doc_id", "lang", "source", "text")))
    return done.select("doc_id", "lang", "source", "ids", F.size("ids").cast("bigint").alias("n_pieces"),
                       F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("suffix-array dedup", drop_repeated_strings),
    ("mixing sources", mix),
    ("SentencePiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
