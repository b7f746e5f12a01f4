"""Naive Bayes from token lists."""

import pytest
from pyspark.sql import functions as F

from tidewake.operators import factor, textops
from tidewake.plans import load_all

SF = "/root/testdata/sf0.001"


def test_scores_of_blocks_equal_those_of_the_term_table(spark, monkeypatch):
    monkeypatch.setattr(factor, "CELLS", 40)
    monkeypatch.setattr(factor, "GROUP", 2)
    rows = [(i, " ".join(f"{'xyz'[(i * j) % 3]}{'abcdefg'[(i + j * j) % 7]}" for j in range(1 + i % 9)), "pqr"[i % 3] if i % 4 else None) for i in range(80)]
    rows += [(80, None, None), (81, "", None), (82, "unknown words", None), (83, "xa xa unknown", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, y string")
    words, some = textops.tokenize("text"), df.where("y is not null")
    tf = textops.term_counts(textops.tokens_of(df, "doc_id", "text"), "doc_id")
    old = textops.naive_bayes(textops.term_counts(some.select("doc_id", "y", words.alias("tokens")), "doc_id", keep=["y"]), "doc_id", "y")
    new = textops.naive_bayes_tokens(some, "doc_id", "y", words)
    flat = lambda m: sorted((r["y"], r["term"] or "", round(r["log_p"], 12), round(r["log_unseen"] or 0, 12)) for r in m.collect())
    assert flat(old) == flat(new)
    want = {r["doc_id"]: r for r in textops.naive_bayes_predict(old, tf, "doc_id", "y").collect()}
    got = {r["doc_id"]: r for r in textops.naive_bayes_predict_tokens(new, df, "doc_id", "y", words, F.length("text")).collect()}
    assert set(got) == set(want) and 83 in got and not {80, 81, 82} & set(got)
    assert all(got[i]["prediction"] == want[i]["prediction"] and got[i]["log_posterior"] == pytest.approx(want[i]["log_posterior"], rel=1e-12) for i in want)


def test_no_term_table_is_cached(spark):
    held = lambda: spark._jsc.sc().getPersistentRDDs().size()
    spark.catalog.clearCache()
    before = held()
    assert load_all()[0]["N12b_naive_bayes_predict"](spark, SF).count() > 0
    assert held() == before
