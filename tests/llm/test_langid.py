import zlib
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tidewake.llm import langid
from tidewake.llm import queries as q

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    r = q.QUERIES["op2_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = r.collect()
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) and 0 <= x["score"] <= 1 for x in rows)
    out = [x["lang"] == x["lang_pred"] for x in rows if x["held_out"] and x["lang"]]
    assert len(out) > 100 and sum(out) / len(out) > 0.98


def grams(text):
    """1- to 3-grams of padded words, letter by letter."""
    out = Counter()
    for w in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
        p = f" {w} "
        out.update(c for c in w)
        out.update(p[i : i + 2] for i in range(len(p) - 1))
        out.update(p[i : i + 3] for i in range(len(p) - 2))
    return out


def packed(gram):
    n = 0
    for c in gram:
        n = n << 21 | ord(c)
    return n


def ranked(counts, top):
    return sorted(counts, key=lambda g: (-counts[g], packed(g)))[:top]


def texts():
    docs = [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet' order by doc_id limit 150").fetchall()]
    return [*docs, None, "", "12 ?!", "İstanbul ΟΔΟΣ ß ǅ", "𝒜𝒷 日本語 한국어 ab", "x" * 5000, "_a_b1c"]


def test_counts_against_brute_force(monkeypatch):
    every = texts()
    for piece in (1 << 20, 300):  # texts counted whole, and in pieces
        monkeypatch.setattr(langid, "PIECE", piece)
        owner, gram, n = langid.count_grams(every, np.arange(len(every)))
        got = [dict(zip(gram[owner == i].tolist(), n[owner == i].tolist())) for i in range(len(every))]
        assert got == [{packed(g): c for g, c in grams(t).items()} for t in every]


def test_profiles_against_brute_force(documents, monkeypatch):
    monkeypatch.setattr(langid, "SLICE_BYTES", 20_000)
    rows = [(i, t, (None, "aa", "bb", "cc")[i % 4]) for i, t in enumerate(texts())]
    sums = {}
    for _, t, lang in rows:
        if lang:
            sums.setdefault(lang, Counter()).update(grams(t))
    got = langid.collect_profiles(langid.learn_profiles(documents(rows).repartition(3), top=50), 50)
    assert got == {k: {packed(g): i for i, g in enumerate(ranked(c, 50))} for k, c in sums.items()}


def test_distances_against_brute_force(documents):
    rows = [(i, t, ("aa", "bb", "cc")[i % 3]) for i, t in enumerate(texts())]
    profiles = langid.collect_profiles(langid.learn_profiles(documents(rows), top=60), 60)
    names, scores = langid.Ranker(profiles, 60).predict([r[1] for r in rows])
    for (_, t, _), name, score in zip(rows, names, scores):
        mine = [packed(g) for g in ranked(grams(t), 60)]
        if not mine:
            assert (name, score) == ("und", 0.0)
            continue
        apart = {k: sum(abs(p[g] - i) if g in p else 60 for i, g in enumerate(mine)) for k, p in profiles.items()}
        best = min(sorted(apart), key=apart.get)
        assert name == best and abs(score - (1 - apart[best] / (60 * len(mine)))) < 1e-12


def test_edges(documents):
    rows = [(0, "das ist ein haus", "de", None), (1, "this is the house", "en", None), (3, None), (4, ""), (5, "123 !!! ²"), (6, "the " * 50_000),
            (8, "the house", None), (8, "the house", None)]
    docs = documents(rows, extra=True)
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, langid.learn_held_out(docs)).collect()}
    assert all(found[d] == ("und", 0.0) for d in (3, 4, 5)) and found[8][0] == "en" and found[6][0] == "en"
    assert langid.identify(docs, {}).where("lang_pred <> 'und'").count() == 0
    assert langid.learn_profiles(documents([])).count() == 0


def test_ties_go_to_the_smaller_name(documents):
    docs = documents([(0, "same words here", "zz"), (1, "same words here", "aa")])
    got = langid.identify(docs, langid.collect_profiles(langid.learn_profiles(docs)))
    assert {r["lang_pred"] for r in got.collect()} == {"aa"}


def test_learning_sees_text_and_language_only(documents):
    docs = documents([(2, "x", "de", "s")]).withColumn("text", F.lit("ja nein"))
    learned = langid.learn_held_out(docs)
    assert set(learned) == ({"de"} if zlib.crc32(b"2") % 4 != 2 else set())
