"""Operator 5: quality rules and a hashed n-gram logistic regression.

Base rules are counts over the words, characters and lines of a whole text.  The model sees words, word pairs and character 2- to
4-grams hashed into ``DIMENSIONS`` buckets, as shares of a text's n-grams; n-grams are hashed and counted in overlapping runs, so a
long text needs no more memory than a run.  It is fitted by MLlib on labelled quality rows and
calibrated (Platt: a logistic regression of the label on the margin) on labelled rows that were not used to fit.  All texts are
scored in Arrow batches; a text is kept if it passes the base rules and its calibrated probability is at least ``keep_at``.

The fit uses a sample of at most about ``max_train`` labelled rows, chosen by a hash of the id; that bound is a parameter.
Everything else covers all rows and whole texts.  The model that tasks get has ``DIMENSIONS`` numbers whatever the data.

A null text has no words and fails the base rules.  Rows without a label, or with a null one, are not learned from; with two
labels for an id the smaller counts.  Without labelled rows of both classes there is no model: the probability is null and the
base rules alone decide.  Repeated rows, empty tables and further columns are allowed.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from .common import WORDS, extended, map_arrow, row_slices, stored

BITS = 16
DIMENSIONS = 1 << BITS
MAX_TRAIN = 6000
SCALE = 100.0
RUN = 1 << 16
TRAIN_PARTS = 8
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
KEEP_AT = 0.5
_COLUMNS = {"n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint",
            "base_failed": "boolean", "margin": "double"}
#: A training row as Python makes it, and as it is read again: the parts of a sparse vector are a vector there.
_MADE = "label double, calibrate boolean, features struct<type: tinyint, size: int, indices: array<int>, values: array<double>>"
_READ = StructType([StructField("label", DoubleType()), StructField("calibrate", BooleanType()), StructField("features", VectorUDT())])
_kept: dict[str, int] = {}


def repeated_words(words: list[str]) -> int:
    """Words that lie in a 3-word window found twice or more, first find included."""
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    covered, upto = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


def base_counts(text: str | None) -> tuple[list[str], list[int]]:
    """Words, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return words, [len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)]


def fails_base(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def _word_hash(word: str) -> int:
    got = _kept.get(word)
    if got is None:
        if len(_kept) >= 100_000:
            _kept.clear()
        got = _kept[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
    return got


def _bucket(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)


def gram_runs(text: str | None, words: list[str]) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text, repeats included, from runs of ``RUN`` words or characters and what an n-gram reaches beyond."""
    if not words:
        return
    one = np.uint64(1)
    for at in range(0, len(words), RUN):
        part = words[at : at + RUN + 1]
        w = np.fromiter(map(_word_hash, part), np.uint64, len(part))
        yield _bucket(w[:RUN] * np.uint64(4) + one)
        yield _bucket((w[:-1] << np.uint64(32) | w[1:]) * np.uint64(5) + one)
    for at in range(0, len(text), RUN):
        c = np.frombuffer(text[at : at + RUN + 3].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        two = c[:-1] << np.uint64(21) | c[1:]
        three = two[:-1] << np.uint64(21) | c[2:]
        four = three[:-1] * np.uint64(0x100000001B3) + c[3:]
        yield _bucket(two[:RUN] * np.uint64(6) + one)
        yield _bucket(three[:RUN] * np.uint64(7) + one)
        yield _bucket(four * np.uint64(9) + one)


def gram_counts(text: str | None, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams in order, and how often each occurs."""
    runs = gram_runs(text, words)
    if len(text or "") <= RUN:
        grams = list(runs)
        return np.unique(np.concatenate(grams), return_counts=True) if grams else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    total = np.zeros(DIMENSIONS, np.int64)
    for grams in runs:
        total += np.bincount(grams.astype(np.int64), minlength=DIMENSIONS)
    at = np.flatnonzero(total)
    return at, total[at]


def mean_weight(weights: np.ndarray, text: str | None, words: list[str]) -> float:
    """Mean weight of a text's n-grams."""
    total, n = 0.0, 0
    for grams in gram_runs(text, words):
        total, n = total + float(weights[grams].sum()), n + len(grams)
    return total / max(1, n)


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN) -> DataFrame:
    """(label, calibrate, features) of the labelled sample, features as the parts of a sparse vector."""
    named = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("label"))
    total = named.count()
    share = min(1.0, max_train / max(1, total))
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    few = named.where(spot < int(share * (1 << 20))).select("doc_id", F.col("label").cast("double").alias("label"),
                                                          (F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5)) == 0).alias("calibrate"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches, "text"):
            out = []
            for t in b.column("text").to_pylist():
                at, n = gram_counts(t, WORDS.findall(t or ""))
                out.append((at.astype(np.int32), n * (SCALE / max(1, n.sum()))))
            parts = [pa.array(np.zeros(len(out), np.int8)), pa.array(np.full(len(out), DIMENSIONS, np.int32)),
                     pa.array([x[0] for x in out], pa.list_(pa.int32())), pa.array([x[1] for x in out], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(
                [b.column("label"), b.column("calibrate"), pa.StructArray.from_arrays(parts, ["type", "size", "indices", "values"])],
                names=["label", "calibrate", "features"])

    rows = docs.select("doc_id", "text").join(F.broadcast(few.limit(2 * max_train)), "doc_id")  # at most 2 * max_train ids
    return map_arrow(rows, features, _MADE)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN, reg: float = 0.01):
    """(weights, intercept, slope, shift) or None: p = 1 / (1 + exp(-(slope * margin + shift)))."""
    rows = stored(training_rows(docs, labels, label, max_train), "quality-sample", _READ)  # no Python from here on
    seen = rows.groupBy("calibrate").agg(F.countDistinct("label").alias("n")).collect()
    if {r["calibrate"]: r["n"] for r in seen}.get(False, 0) < 2:
        return None
    # a fixed number of parts: each step sends one gradient per part
    model = LogisticRegression(maxIter=40, regParam=reg, tol=1e-5).fit(rows.where("not calibrate").coalesce(TRAIN_PARTS))
    weights, intercept = model.coefficients.toArray(), float(model.intercept)
    slope, shift = 1.0, 0.0
    if {r["calibrate"]: r["n"] for r in seen}.get(True, 0) == 2:
        margins = model.transform(rows.where("calibrate")).select("label", vector_to_array("rawPrediction")[1].alias("margin"))
        scored = VectorAssembler(inputCols=["margin"], outputCol="features").transform(margins).select("label", "features")
        platt = LogisticRegression(maxIter=50, regParam=1e-3, standardization=False).fit(scored)
        slope, shift = float(platt.coefficients[0]), float(platt.intercept)
        if slope <= 0:  # an uninformative margin must not be turned round
            slope, shift = 1.0, 0.0
    return weights, intercept, slope, shift


def score_quality(docs: DataFrame, model, text: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """``docs`` with base counts, base_failed, margin, probability and kept."""
    keep = [c for c in docs.columns if c not in (*_COLUMNS, "probability", "kept")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in row_slices(batches, text):
            counts, margins = [], []
            for t in b.column(text).to_pylist():
                words, n = base_counts(t)
                counts.append([*n, fails_base(n[0], n[4])])
                if model is None:
                    margins.append(None)
                else:
                    margins.append(model[1] + SCALE * mean_weight(model[0], t, words))
            made = [pa.array(c, pa.bool_() if i == 5 else pa.int64()) for i, c in enumerate(zip(*counts))] if counts else [
                pa.array([], pa.bool_() if i == 5 else pa.int64()) for i in range(6)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *made, pa.array(margins, pa.float64())], names=[*keep, *_COLUMNS])

    schema = docs.select(*keep).schema
    scored = map_arrow(docs.select(*keep), run, extended(schema, **_COLUMNS))
    slope, shift = (model[2], model[3]) if model else (1.0, 0.0)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("margin") * slope + shift)))
    verdict = ~F.col("base_failed") & F.coalesce(F.col("probability") >= keep_at, F.lit(True))
    return scored.withColumn("probability", p).withColumn("kept", verdict)
