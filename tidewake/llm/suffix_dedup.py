"""Operator 6: removal of repeated byte strings by distributed prefix doubling.

Every byte covered by a string of ``LENGTH`` bytes that also starts earlier (smaller id, or same document and earlier start) is
removed; overlaps count, strings are judged on the input and never cross documents.

Prefix doubling ranks all positions by their first h bytes, then by pairs of ranks h apart, drops positions whose rank is
unique and stops once h passes the threshold.  Done for every byte, that would move many times the input; here the positions
are those that the strings themselves choose:

* Inside a task, ranks of 1, 2, 4, ... bytes are doubled up to ``K`` bytes (ranks are fingerprints, so equal strings have equal
  ranks in every task).  Each string of ``LENGTH`` bytes is represented by its position of smallest ``K``-byte rank, which equal
  strings choose alike.  Consecutive strings with one representative are a run.
* *Round 1* sorts runs by (rank of the ``K`` bytes at the representative, rank of the run's whole stretch).  Runs whose first
  rank is unique hold no repeated string and are dropped.  Of runs with equal stretches the first in document order stays and
  the others are removed whole.  Stretches without a partner of another stretch are finished.
* *Round 2* cuts what is left into runs of ``STEP`` strings, at offsets fixed by the representative, and ranks them by the
  ``LENGTH - STEP + 1`` bytes that all of them share, paired with the rank of their stretch.
* *Round 3* ranks the strings that are left one by one.

So the ranked length grows from round to round until it passes the threshold, each round sorts fewer positions, and none of
them holds a row per byte.  Rows that are later than an equal run of the same batch are settled before the shuffle, so a group
of copies or a passage that a third of all documents hold is thin when its rank is sorted; counts are combined before the
shuffle and the joins on ranks can be split by adaptive execution.  Rounds are written to the shared folder.

A null text is empty.  A null id comes after all others.  A document is a distinct (id, text): rows that share both are repeated
rows of it, and each keeps and loses the same bytes.  Texts that share an id, or have none, are documents of their own, in the order
of a hash of the text; the key of a document is its id and that hash (127 bits).  Texts of any length are used whole; texts shorter than ``LENGTH`` lose nothing.
Empty tables and further columns are allowed; columns of the same names as those added are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import extended, fresh_name, map_arrow, mix64, row_slices, stored

LENGTH, K, STEP = 100, 32, 8
SHARED = LENGTH - STEP + 1
SLICE_BYTES = 1 << 20
LAST = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(6).integers(0, 1 << 64, 256, dtype=np.uint64)
KEY = ["doc", "h1", "h2"]
_RUNS = "core bigint, full bigint, doc bigint, h1 bigint, h2 bigint, pos int, n int, off int, done boolean"


def document_key(key: str, text: str) -> list[Column]:
    """doc, h1, h2: documents are ordered by them; the sign of h1 puts a null id after the largest one."""
    none = F.col(key).cast("bigint").isNull()
    h1 = F.xxhash64(text)
    return [F.coalesce(F.col(key).cast("bigint"), F.lit(LAST)), F.when(none, h1.bitwiseAND(F.lit(LAST))).otherwise(h1.bitwiseOR(F.lit(-LAST - 1))),
            F.xxhash64(F.lit(6), text)]


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


class Ranks:
    """Fingerprint ranks of all positions of a byte array for lengths that are sums of powers of two, by doubling."""

    def __init__(self, data: np.ndarray):
        self.of = {1: _BYTE[data]}
        h = 1
        while 2 * h <= LENGTH and len(data) >= 2 * h:
            self.of[2 * h] = self._pair(self.of[h], h, self.of[h], h)
            h *= 2

    @staticmethod
    def _pair(left, a, right, b):
        """Ranks of a + b bytes from pairs of ranks ``a`` apart."""
        n = max(0, len(left) - b)
        return left[:n] * _power(b) + right[a : a + n]

    def __call__(self, length: int) -> np.ndarray:
        out, have = None, 0
        for h in sorted(self.of, reverse=True):
            if have + h <= length:
                out, have = (self.of[h], h) if out is None else (self._pair(out, have, self.of[h], h), have + h)
        return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _stretch(r100, first, last, offset):
    """Rank of the bytes of a run of strings: from those of its first and last, which overlap or touch, and its place."""
    return mix64(r100[first] + np.uint64(3) * mix64(r100[last] + np.uint64(5) * (last - first).astype(np.uint64)
                                                    + np.uint64(7) * offset.astype(np.uint64)))


def _later(core, full, doc, pos) -> np.ndarray:
    """Rows that come after an equal (core, full) row of the same batch."""
    order = np.lexsort((pos, doc, full, core))
    c, f, d, p = core[order], full[order], doc[order], pos[order]
    new = np.ones(len(order), bool)
    new[1:] = (c[1:] != c[:-1]) | (f[1:] != f[:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    out = np.zeros(len(order), bool)
    out[order] = (d != d[head]) | (p != p[head])
    return out


def _joined(texts: list[str | None]):
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    starts = np.cumsum(sizes) - sizes
    return np.frombuffer(b"".join(raw), np.uint8), sizes, starts


def first_runs(texts: list[str | None]):
    """Runs of strings with one representative: core, full, row, pos, n, off arrays."""
    data, sizes, starts = _joined(texts)
    n = len(data) - LENGTH + 1
    if n <= 0:
        return None
    ranks = Ranks(data)
    k = mix64(ranks(K))
    at = np.arange(len(k), dtype=np.uint64)
    least = (k & ~np.uint64((1 << 24) - 1)) | at  # slices are shorter than 2^24 bytes or hold one text
    if len(data) >= 1 << 24:  # one very long text: exact order by rank, then place
        least = np.empty(len(k), np.uint64)
        least[np.lexsort((at, k))] = at
        back = np.argsort(least)
    width, h = LENGTH - K + 1, 1
    while 2 * h <= width:
        least, h = np.minimum(least[:-h], least[h:]), 2 * h
    least = np.minimum(least[:n], least[width - h : width - h + n])
    rep = back[least.astype(np.int64)] if len(data) >= 1 << 24 else (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    p = np.flatnonzero(row[:n] == row[LENGTH - 1 :])
    if not len(p):
        return None
    r = rep[p]
    edge = np.ones(len(p), bool)
    edge[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1)
    head = np.flatnonzero(edge)
    tail = np.append(head[1:], len(p)) - 1
    first, last, anchor = p[head], p[tail], r[head]
    mine = row[first]
    full = _stretch(ranks(LENGTH), first, last, anchor - first)
    return (_signed(k[anchor]), _signed(full), mine, (first - starts[mine]).astype(np.int32), (last - first + 1).astype(np.int32),
            (anchor - first).astype(np.int32))


def _run_batch(b: pa.RecordBatch, core, full, row, pos, n, off) -> pa.RecordBatch:
    """Runs of the rows of ``b`` under the keys of their documents."""
    key = [b.column(c).to_numpy() for c in KEY]
    by = np.lexsort(key[::-1])
    place = np.zeros(len(by), np.int64)  # rows of one document have one place
    place[by[1:]] = np.cumsum(np.any([k[by[1:]] != k[by[:-1]] for k in key], axis=0))
    done = _later(core, full, place[row], pos)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (core, full, *[k[row] for k in key], pos, n, off, done)],
                                      names=["core", "full", *KEY, "pos", "n", "off", "done"])


def list_first_runs(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches, "text", SLICE_BYTES):
            got = first_runs(b.column("text").to_pylist())
            if got:
                yield _run_batch(b, *got)

    return map_arrow(docs.select(*KEY, "text"), run, _RUNS)


def list_short_runs(docs: DataFrame, left: DataFrame) -> DataFrame:
    """Runs of at most ``STEP`` strings of the runs that are left, with the rank of each string in ``each``."""
    per = left.groupBy(*KEY).agg(F.collect_set(F.struct("pos", "n", "off")).alias("runs"))  # bounded by the document's length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches, "text", SLICE_BYTES):
            data, sizes, starts = _joined(b.column("text").to_pylist())
            runs = b.column("runs")
            count = runs.value_lengths().to_numpy()
            flat = runs.flatten()
            pos, n, off = (flat.field(i).to_numpy().astype(np.int64) for i in range(3))
            mine = np.repeat(np.arange(len(count)), count)
            if not len(pos):
                continue
            ranks = Ranks(data)
            r100, shared = ranks(LENGTH), ranks(SHARED)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            which = np.repeat(np.arange(len(n)), n)
            away = off[which] - step  # of the string's representative
            p = starts[mine[which]] + pos[which] + step
            part = away // STEP
            edge = np.ones(len(p), bool)
            edge[1:] = (which[1:] != which[:-1]) | (part[1:] != part[:-1])
            head = np.flatnonzero(edge)
            tail = np.append(head[1:], len(p)) - 1
            first, last, own = p[head], p[tail], mine[which[head]]
            core = mix64(shared[first + away[head] - STEP * part[head]])
            full = _stretch(r100, first, last, away[head])
            rows = _run_batch(b, _signed(core), _signed(full), own, (first - starts[own]).astype(np.int32),
                              (tail - head + 1).astype(np.int32), away[head].astype(np.int32))
            each = pa.ListArray.from_arrays(pa.array(np.append(head, len(p)).astype(np.int32)), pa.array(_signed(r100[p])))
            yield pa.RecordBatch.from_arrays([*rows.columns, each], names=[*rows.schema.names, "each"])

    return map_arrow(docs.select(*KEY, "text").join(per, KEY), run, _RUNS + ", each array<bigint>")


def settle(runs: DataFrame) -> DataFrame:
    """Sorts runs by rank pairs: ``gone`` for runs later than an equal one, ``open`` for first ones whose core has others."""
    seen = runs.where("not done").groupBy("core").agg(F.count(F.lit(1)).alias("seen")).where("seen > 1")
    alive = runs.join(seen, "core", "left").where("done or seen is not null").drop("seen")
    # settled rows need no rank: they are spread instead of meeting their group.  The rank has a shuffle of its own, so the join
    # above may be split where many stretches share a core
    alive = alive.withColumn("apart", F.when(F.col("done"), F.xxhash64(*KEY, "pos"))).repartition("core", "full", "apart")
    first = F.rank().over(W.partitionBy("core", "full", "apart").orderBy(*KEY, "pos")) == 1
    ranked = alive.withColumn("gone", F.col("done") | ~first)
    return stored(ranked.drop("done", "apart"), "runs")


def still_open(ranked: DataFrame) -> DataFrame:
    """First runs whose core is shared with another stretch."""
    firsts = ranked.where("not gone")
    others = firsts.groupBy("core").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("core")
    return firsts.join(others, "core")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, h1, h2, pos, n): strings pos .. pos + n - 1 of a document that start earlier elsewhere."""
    one = settle(list_first_runs(docs))
    two = settle(list_short_runs(docs, stored(still_open(one).select(*KEY, "pos", "n", "off"), "open-runs")))
    single = still_open(two).select("core", *KEY, "pos", F.posexplode("each").alias("i", "full"))
    single = single.select("core", "full", *KEY, (F.col("pos") + F.col("i")).cast("int").alias("pos"), F.lit(1).alias("n"),
                           F.lit(0).alias("off"), F.lit(False).alias("done"))
    three = settle(single)
    gone = [x.where("gone").select(*KEY, "pos", "n") for x in (one, two, three)]
    return gone[0].union(gone[1]).union(gone[2])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n_bytes, n_removed, removed (runs as start and length in bytes), kept (binary), kept_sha256 and
    kept_text: the kept bytes without the rest of characters that a removal cuts."""
    made = {"n_bytes": "bigint", "n_removed": "bigint", "removed": "array<struct<start:int,length:int>>",
            "kept": "binary", "kept_text": "string",
            "kept_sha256": "string"}
    keep = [c for c in docs.columns if c not in made]
    names = [fresh_name(docs.columns, f"_{c}") for c in KEY]
    found = fresh_name(docs.columns, "_spans")
    spans = repeated_spans(docs.select(*[k.alias(c) for k, c in zip(document_key(key, text), KEY)], F.col(text).alias("text")))
    per = spans.groupBy(*[F.col(c).alias(x) for c, x in zip(KEY, names)]).agg(F.collect_set(F.struct("pos", "n")).alias(found))
    rows = docs.select(*keep, *[k.alias(x) for k, x in zip(document_key(key, text), names)]).join(per, names, "left").drop(*names)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))

    def cut(t: str | None, spans):
        raw = (t or "").encode("utf-8", "surrogatepass")
        mark = np.zeros(len(raw) + 1, np.int32)
        for s in spans or ():
            mark[min(s["pos"], len(raw))] += 1
            mark[min(s["pos"] + s["n"] + LENGTH - 1, len(raw))] -= 1
        gone = np.cumsum(mark) > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])))
        edge = edge if len(edge) % 2 == 0 else np.append(edge, len(raw))
        kept = np.frombuffer(raw, np.uint8)[~gone[:-1]].tobytes()
        runs = [{"start": int(a), "length": int(b - a)} for a, b in zip(edge[::2], edge[1::2])]
        return len(raw), len(raw) - len(kept), runs, kept, kept.decode("utf-8", "ignore"), hashlib.sha256(kept).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches, text):
            got = [cut(t, s) for t, s in zip(b.column(text).to_pylist(), b.column(found).to_pylist())]
            types = [pa.int64(), pa.int64(), kind, pa.binary(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *[pa.array([g[i] for g in got], t) for i, t in enumerate(types)]],
                                             names=[*keep, *made])

    return map_arrow(rows, run, extended(docs.select(*keep).schema, **made))
