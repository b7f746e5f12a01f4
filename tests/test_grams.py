"""N-gram counts by blocks: brute force, odd lists, cut blocks, and what is shuffled."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewake.operators import grams
from tidewake.operators import textops as n

LISTS = [["a", "b", "a", "b"], [], None, ["a"], ["a", None, "b"], ["<s>", "x", "</s>"], ["é", "a", "b", "a", "b", "a"], ["a", "b", "a", "b"]]


def brute(lists, k, padded):
    out = Counter()
    for t in lists:
        if t is not None:
            t = ["<s>"] * (max(k, 2) - 1) + t + ["</s>"] if padded else t
            out.update(tuple(t[i : i + k]) for i in range(len(t) - k + 1))
    return out


@pytest.mark.parametrize("k,padded", [(1, False), (2, True), (3, False), (4, True), (6, True)])
def test_counts_equal_brute_force(spark, k, padded):
    df = spark.createDataFrame([(x,) for x in LISTS], "tokens array<string>").repartition(3)
    got = n.ngrams(df, k, padded=padded).collect()
    assert {tuple(r)[:k]: r["n"] for r in got} == brute(LISTS, k, padded) and len(got) == len(brute(LISTS, k, padded))
    assert n.ngrams(df.where("false"), k, padded=padded).count() == 0


def test_blocks_cut_between_lists_only():
    batch = pa.RecordBatch.from_arrays([pa.array(LISTS * 5, pa.list_(pa.string()))], names=["t"])
    for size in (1, 5, 7, 1000):
        got = [x.to_pylist() for x in grams._blocks(iter([batch.slice(1), batch.slice(3, 4)]), size)]
        assert sum(got, []) == (LISTS * 5)[1:] + (LISTS * 5)[3:7]
        assert all(len(x) == 1 or sum(len(t or []) for t in x) <= size + 6 for x in got)


def test_keys_stay_exact_beyond_64_bits():
    rnd = np.random.default_rng(1)
    base = 1 << 30
    rows = rnd.integers(base - 4, base, (5000, 6))
    cols, total = grams._counted([rows[:, i] for i in range(6)], base)
    assert Counter(dict(zip(zip(*(c.tolist() for c in cols)), total.tolist()))) == Counter(map(tuple, rows.tolist()))


def test_no_row_per_ngram_is_shuffled(spark):
    """Rows of the exchange are one per block and group, not one per n-gram."""
    df = spark.range(2000, numPartitions=1).select(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.concat(F.lit("w"), F.col("id") * 20 + i)).alias("tokens"))
    plan = n.ngrams(df, 4)
    assert plan.count() == 2000 * 21
    sent = plan.select("w1")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in sent and "Generate" not in sent and "MapInArrow" in sent
    rows = df.select("tokens").mapInArrow(grams._deal(4, True, grams.PARTS), "_p int, words array<string>, grams binary, n binary")
    assert rows.count() <= grams.PARTS


def test_sentences_from_bytes_equal_the_column_functions(spark):
    """Sentence n-grams without a regular expression per sentence: the same lists as ``sentence_tokens``."""
    rnd = random.Random(5)
    parts = ["ab", "c", "Dé", "_x", "İI", "\u212aq", "ΑΣ", "ß", ".", "!", "?", " ", "\n", "\r", "\t", "\x0b", "\x0c", "\u00a0", "\u2028", "7", "\U0001f600", "ab ", ". ", "..\n"]
    texts = [None, "", " ", ".", "ab", "a", ". ab", "ab.", "ab.cd", "\n\nab", *["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 40))) for _ in range(3000)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for d in (df, docs, df.where("false")):
        want = n.sentence_tokens(d, "doc_id", "text").select("tokens")
        assert Counter(tuple(r[0]) for r in want.collect()) == Counter(
            tuple(x) for b in grams.sentence_lists(iter(d.select("text").toArrow().to_batches(max_chunksize=700))) for x in b.column(0).to_pylist())
        a, b = n.ngrams(want, 4), n.sentence_ngrams(d, "text", 4)
        assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    assert "regexp" not in n.sentence_ngrams(df, "text", 4)._jdf.queryExecution().optimizedPlan().toString()
