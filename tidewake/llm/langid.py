"""Operator 2: language identification by rank-order profiles.

A profile lists the ``top`` most frequent character n-grams (1 to 3 characters, words padded by a blank on both sides), most
frequent first, equal counts by n-gram.  Learning adds up the n-grams of all training texts per language: tasks combine the
counts of their batches, Spark adds them up, and the lists are cut in two steps so that no task ranks a whole language alone.
A text gets the language with the smallest out-of-place distance: the sum, over its own ``top`` n-grams, of the difference of
ranks, or ``top`` for an n-gram that the profile lacks.  Equal distances go to the smaller language name.  The score is one less
the distance over the largest possible one.

Words are runs of letters (Unicode category L), lower-cased.  An n-gram is packed into 63 bits; a batch of texts is counted by one
sort of small integers, and very long texts in pieces.

A null text, or one without a letter, is ``und`` with score 0, as is every text if nothing was learned.  Texts are used whole.
What reaches the driver is the profiles: ``top`` numbers for each of at most ``MAX_LANGUAGES`` languages.  Empty tables,
repeated rows and further columns are allowed; the columns added replace columns of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import extended, map_arrow, row_slices

TOP = 300
MAX_N = 3
MAX_LANGUAGES = 2000
SLICE_BYTES = 1 << 19
PIECE = 1 << 19  #: characters of a very long text that are counted at once
MERGE = 1 << 20  #: n-gram counts that a learning task holds before it passes them on
UNKNOWN = "und"
_NO_LETTER = re.compile(r"[\W\d_]")


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _sum_up(grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, ascending, with the sums of their counts."""
    at, inverse = np.unique(grams, return_inverse=True)
    return at, np.bincount(inverse, n, len(at)).astype(np.int64)


def _count(texts: list[str], owner: np.ndarray):
    """n-grams of lower-case texts added up by owner: (owner, packed n-gram, count) arrays, ascending.

    The letters of the batch are numbered, so an n-gram is a small integer and one sort counts all of them.
    """
    sizes = np.array([len(t) + 1 for t in texts])
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after each word
    if not keep.any():
        return (np.zeros(0, np.int64),) * 3
    blank = np.concatenate([[True], ~letter[keep]])
    used = np.concatenate([[32], codes[keep]]).astype(np.int64)
    used[blank] = 32
    mine = np.repeat(owner, sizes)[keep]
    mine = np.concatenate([mine[:1], mine])
    alphabet = np.flatnonzero(np.bincount(used))
    number = np.zeros(alphabet[-1] + 1, np.int64)
    number[alphabet] = np.arange(len(alphabet))
    bits = max(1, int(len(alphabet) - 1).bit_length())
    whole = 3 * bits + 2
    if int(owner.max(initial=0)).bit_length() + whole > 63:  # a huge alphabet: one owner at a time
        parts = []
        for o in np.unique(owner):
            _, grams, n = _count([t for t, x in zip(texts, owner) if x == o], np.zeros(int((owner == o).sum()), np.int64))
            parts.append((np.full(len(grams), o), grams, n))
        return tuple(np.concatenate(c) for c in zip(*parts))
    kind = np.uint32 if int(owner.max(initial=0)).bit_length() + whole <= 32 else np.int64
    c, mine, place = number[used].astype(kind), mine.astype(kind), kind(bits)
    two = c[:-1] << place | c[1:]
    three = two[:-1] << place | c[2:]
    ones, pairs, triples = ~blank, ~(blank[:-1] & blank[1:]), ~blank[1:-1]
    lead = np.where(blank[:-1], mine[1:], mine[:-1])  # a blank belongs to no text: its letter does
    keys = np.concatenate([
        mine[ones] << kind(whole) | c[ones],
        lead[pairs] << kind(whole) | kind(1 << 3 * bits) | two[pairs],
        mine[1:-1][triples] << kind(whole) | kind(2 << 3 * bits) | three[triples]])
    keys.sort()
    head = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    n = np.diff(np.append(head, len(keys)))
    keys = keys[head].astype(np.int64)
    own, code = keys >> whole, keys & ((1 << whole) - 1)
    order, low = code >> 3 * bits, (1 << bits) - 1
    grams = alphabet[code & low]
    grams = np.where(order > 0, grams | alphabet[code >> bits & low] << 21, grams)
    grams = np.where(order > 1, grams | alphabet[code >> 2 * bits & low] << 42, grams)
    return own, grams, n


def count_grams(texts: list[str | None], owner: np.ndarray):
    """(owner, packed n-gram, count) of the 1- to 3-grams of padded words, ascending by owner and n-gram."""
    low, own, parts = [], [], []
    for t, o in zip(texts, owner.tolist()):
        t = t.lower() if t else ""
        while len(t) > PIECE and (cut := _NO_LETTER.search(t, PIECE)):  # a very long text is counted in pieces
            parts.append(_count([t[: cut.end()]], np.array([o])))
            t = t[cut.end() :]
        low.append(t)
        own.append(o)
    if not parts:
        return _count(low, np.array(own, np.int64)) if low else (np.zeros(0, np.int64),) * 3
    parts.append(_count(low, np.array(own, np.int64)))
    o, g, n = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((g, o))
    o, g, n = o[order], g[order], n[order]
    head = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (g[1:] != g[:-1])])) if len(o) else np.zeros(0, np.int64)
    return o[head], g[head], np.add.reduceat(n, head) if len(head) else n


def learn_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP) -> DataFrame:
    """(lang, gram, rank) with ranks from 0, from all rows whose language is not null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def rows():
            for k, v in held.items():
                grams, n = _sum_up(*(np.concatenate(c) for c in zip(*v)))
                held[k] = [(grams, n)]
                yield pa.RecordBatch.from_pydict({"lang": pa.array([k] * len(grams), pa.string()), "gram": grams, "n": n})

        for b in row_slices(batches, text, SLICE_BYTES):
            kinds = sorted(set(b.column(lang).to_pylist()))
            of = {k: i for i, k in enumerate(kinds)}
            owner, grams, n = count_grams(b.column(text).to_pylist(), np.array([of[k] for k in b.column(lang).to_pylist()], np.int64))
            edges = np.searchsorted(owner, np.arange(len(kinds) + 1))
            for k, i, j in zip(kinds, edges, edges[1:]):
                if j > i:
                    held.setdefault(k, []).append((grams[i:j], n[i:j]))
                    size += j - i
            if size > MERGE:
                out = list(rows())
                size = sum(x.num_rows for x in out)
                if size > MERGE // 2:
                    yield from out
                    held, size = {}, 0
        yield from rows()

    rows = docs.select(F.col(text).cast("string").alias(text), F.col(lang).cast("string").alias(lang)).where(F.col(lang).isNotNull())
    n = map_arrow(rows, count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_count = [F.col("n").desc(), F.col("gram")]
    part = n.withColumn("_s", F.pmod(F.xxhash64("gram"), F.lit(64)))
    part = part.withColumn("_r", F.row_number().over(W.partitionBy("lang", "_s").orderBy(*by_count))).where(F.col("_r") <= top)
    ranked = part.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*by_count)) - 1)
    return ranked.where(F.col("rank") < top).select("lang", "gram", "rank")


def collect_profiles(profiles: DataFrame, top: int = TOP) -> dict[str, dict[int, int]]:
    """Profiles as plain maps; their size is bounded by ``top * MAX_LANGUAGES``."""
    out: dict[str, dict[int, int]] = {}
    for lang, gram, rank in profiles.limit(top * MAX_LANGUAGES + 1).collect():
        out.setdefault(lang, {})[gram] = rank
    if len(out) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return out


class Ranker:
    """Profiles as (n-gram, language, rank) entries, ascending by n-gram: as many as the profiles have, whatever the languages."""

    def __init__(self, profiles: dict[str, dict[int, int]], top: int = TOP):
        self.langs, self.top = sorted(profiles), top
        rows = sorted((g, j, r) for j, k in enumerate(self.langs) for g, r in profiles[k].items())
        self.gram, self.lang, self.rank = (np.array([x[i] for x in rows], np.int64) for i in range(3))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        owner, grams, n = count_grams(texts, np.arange(len(texts)))
        names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        if not self.langs or not len(owner):
            return names.tolist(), scores
        order = np.lexsort((grams, -n, owner))
        owner, grams = owner[order], grams[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        owner, grams, place = (x[place < self.top] for x in (owner, grams, place))
        mine = np.bincount(owner, minlength=len(texts))
        # all n-grams count as missing at first; each profile entry that meets one corrects its language
        first, last = np.searchsorted(self.gram, grams), np.searchsorted(self.gram, grams, "right")
        times = last - first
        entry = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)
        gain = self.top - np.abs(self.rank[entry] - np.repeat(place, times))
        there, k = np.flatnonzero(mine), len(self.langs)
        cell = np.searchsorted(there, np.repeat(owner, times)) * k + self.lang[entry]
        apart = self.top * mine[there][:, None] - np.bincount(cell, gain, len(there) * k).reshape(-1, k)
        best = apart.argmin(axis=1)
        names[there] = np.array(self.langs, object)[best]
        scores[there] = 1.0 - apart[np.arange(len(there)), best] / (self.top * mine[there])
        return names.tolist(), scores


def identify(docs: DataFrame, profiles: dict[str, dict[int, int]], text: str = "text", top: int = TOP) -> DataFrame:
    """``docs`` with lang_pred and score."""
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(profiles, top)
        for b in row_slices(batches, text, SLICE_BYTES):
            names, scores = ranker.predict(b.column(text).to_pylist())
            made = [pa.array(names, pa.string()), pa.array(scores)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *made], names=[*keep, "lang_pred", "score"])

    return map_arrow(docs, run, extended(docs.schema, lang_pred="string", score="double"))


def held_out(doc_id: str = "doc_id"):
    """Rows kept out of learning; a null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn_held_out(docs: DataFrame, top: int = TOP) -> dict[str, dict[int, int]]:
    """Profiles from the rows of ``docs`` (doc_id, text, lang) that are not held out."""
    return collect_profiles(learn_profiles(docs.where(~held_out()), top=top), top)
