import random

import numpy as np
import pytest

from tidewake.llm import quality
from tidewake.llm import queries as q
from tidewake.llm.common import WORDS

SF = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    w = WORDS.findall(text)
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    repeat = sum(any(0 <= j < len(wins) and wins.count(wins[j]) > 1 for j in (i - 2, i - 1, i)) for i in range(len(w)))
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, repeat]


def test_base_counts():
    rnd = random.Random(1)
    for _ in range(300):
        t = "".join(rnd.choice(["a ", "b ", "c ", "é\n", "|", "<x> ", "\u00a0", "\x0b", "\n"]) for _ in range(rnd.randint(0, 60)))
        assert quality.base_counts(t)[1] == brute(t), t
    assert quality.base_counts(None)[1] == [0] * 5


@pytest.fixture(scope="module")
def scored(spark):
    return q.QUERIES["op5_quality_rules"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "left").collect()


def test_query_verdicts(scored):
    for r in scored:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["probability"] >= 0.5)


def test_model_follows_labels(scored):
    """Rows with a quality label that pass the base rules: nearly all are judged as labelled."""
    seen = [r["kept"] == bool(r["quality"]) for r in scored if r["quality"] is not None and not r["base_failed"]]
    assert sum(seen) / len(seen) > 0.97


def test_held_out_labels(spark):
    """A model that saw one half of the labels orders the other half."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit_quality(docs, labels.where("doc_id % 2 = 0"))
    rows = quality.score_quality(docs.select("doc_id", "text"), model).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good = [r["probability"] for r in rows if r["quality"] == 1]
    bad = [r["probability"] for r in rows if r["quality"] == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.9


def test_edges(spark, documents):
    docs = documents([(1, None), (2, ""), (3, "a b c " * 200), (4, " ".join(f"w{i}" for i in range(80_000))), (4, "x"), (None, "x")], extra=True)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    one = spark.createDataFrame([(4, 1, 0), (4, None, 0), (None, 0, 0)], "doc_id bigint, quality int, toxic int")
    for labels in (none, one):
        assert quality.fit_quality(docs, labels) is None
    got = quality.score_quality(docs, None).collect()
    assert len(got) == 6 and {(r["doc_id"], r["kept"]) for r in got} == {(1, False), (2, False), (3, False), (4, True), (4, False), (None, False)}
    assert quality.score_quality(documents([]), None).count() == 0


def test_grams_of_all_lengths_and_memory_of_long_texts(monkeypatch):
    """Words, word pairs and 2- to 4-grams are all counted, alike for any run length, in bounded memory."""
    import tracemalloc

    rnd = random.Random(3)
    weights = np.random.default_rng(3).normal(size=quality.DIMENSIONS)
    texts = ["", " ", "a", "ab", "abc", "a b", *["".join(rnd.choice("abé \n\U0001f600") for _ in range(n)) for n in (15, 16, 17, 18, 19, 20, 33, 500)]]
    whole = [(quality.gram_counts(t, WORDS.findall(t)), quality.mean_weight(weights, t, WORDS.findall(t))) for t in texts]
    for t, ((at, n), _) in zip(texts, whole):
        w, c = len(WORDS.findall(t)), len(t)
        assert n.sum() == (w + w - 1 + sum(max(0, c - k) for k in (1, 2, 3)) if w else 0), t
    monkeypatch.setattr(quality, "RUN", 16)
    for t, ((at, n), m) in zip(texts, whole):
        got = quality.gram_counts(t, WORDS.findall(t))
        assert list(got[0]) == list(at) and list(got[1]) == list(n), t
        assert quality.mean_weight(weights, t, WORDS.findall(t)) == pytest.approx(m)
    monkeypatch.undo()
    long = "ab cd " * 500_000
    words = WORDS.findall(long)
    tracemalloc.start()
    quality.gram_counts(long, words), quality.mean_weight(weights, long, words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20


def test_fit_reads_vectors_without_python(spark):
    """The stored sample is read as sparse vectors: no step of the fit hands its rows to Python workers again."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    made = quality.training_rows(docs, labels)
    rows = quality.stored(made, "quality-test", quality._READ)
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    texts = {r["text"] for r in docs.join(labels.where("quality is not null"), "doc_id").collect()}
    want = sorted((list(at), list(n * (quality.SCALE / max(1, n.sum())))) for at, n in (quality.gram_counts(t, WORDS.findall(t or "")) for t in texts))
    seen = {(tuple(r["features"].indices), tuple(r["features"].values)) for r in rows.collect() if r["features"].size == quality.DIMENSIONS}
    assert sorted((list(i), list(v)) for i, v in seen) == want


def test_fit_runs_no_python_rows(spark, monkeypatch):
    """The fit asks for no Python UDF."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    monkeypatch.setattr(quality.F, "udf", lambda *a, **k: pytest.fail("a Python UDF in the fit"))
    weights, _, slope, _ = quality.fit_quality(docs, labels)
    assert len(weights) == quality.DIMENSIONS and slope > 0
