"""Operator 11: ranked lexical search by dense blocked matrix products.

Terms are the maximal runs of digits, ASCII letters and characters beyond ASCII, A-Z in lower case.  With N documents that hold
a term, L terms in all, n terms in a document, df documents of a term and tf its occurrences in a document::

    w = floor(1000 * ln((2N + 2) / (2df + 1)))      m = 10 + (90 * n * N) div L
    score = sum of w * ((1000000000 * tf) div (1000 * tf + 8 * m)) over the item's terms, once each

1. One pass over the documents counts their terms and keeps the (term, tf) cells whose term may belong to an item, by a bit table
   of at most 8 MB; one row per document is stored.  N, L and df come from these rows.
2. Items are packed into tiles of at most ``ITEMS`` items with the vocabulary of these items alone, in parts of at most ``TERMS``
   terms.  Tiles are sent to the tasks in passes of at most about ``PASS`` (item, term) entries, however many items there are.
3. A task takes ``DOCS`` documents at a time.  Their impacts become a dense float64 matrix (terms that occur in this tile of
   documents x documents), which is multiplied by the weights (items x terms) of each tile: one BLAS product for each part of the
   vocabulary.  An impact is below 10^6 and a weight below 1000 * ln(2^64) < 44,400, so a sum over ``TERMS`` terms stays below
   1.9 * 10^14 < 2^53 and every product is exact; parts are added up as 64-bit integers.
4. Of each product the documents at or above the k-th score stay, ties included, and are merged in the order (score, doc_id) into
   the k best of the task; those of all tasks are cut to k in two steps.

Documents with a null id count in N, L and df but get no rank, as do all with a score of 0.  Repeated rows are documents of their
own.  Benchmark rows that share an id are one item with the terms of all of them; rows without an id or a term give nothing.
Terms are compared by 64-bit fingerprints.  Texts are used whole; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import in_batches, row_slices, stored
from .terms import SLICE_BYTES, bit_table, lists, may_hold, word_prints

K = 10
ITEMS, TERMS, DOCS = 64, 4096, 1024
PASS = 1 << 18
_NO_ID = np.iinfo(np.int64).max
MOST_WEIGHT, MOST_IMPACT = 44_400, 10**6
assert TERMS * MOST_WEIGHT * MOST_IMPACT < 1 << 53


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term): the distinct terms of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches, "text", SLICE_BYTES):
            prints, upto = word_prints(b.column("text"))
            own = np.repeat(b.column("item_id").to_numpy(), np.diff(upto))
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(prints.view(np.int64))], names=["item_id", "term"])

    rows = items.select(F.col(key).cast("bigint").alias("item_id"), F.col(text).alias("text")).where("item_id is not null")
    return in_batches(rows).mapInArrow(run, "item_id bigint, term bigint").distinct()


def document_cells(docs: DataFrame, table: np.ndarray, bits: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, tf) of each document with a term; ``terms`` are those that the bit table lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches, "text", SLICE_BYTES):
            prints, upto = word_prints(b.column("text"))
            at = may_hold(shared.value, bits, prints)
            doc, term = np.searchsorted(upto, at, "right") - 1, prints[at]
            order = np.lexsort((term, doc))
            doc, term = doc[order], term[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
            head = np.flatnonzero(new)
            tf = np.diff(np.append(head, len(doc)))
            ends = np.searchsorted(doc[head], np.arange(b.num_rows + 1))
            cols = [b.column("doc_id"), pa.array(np.diff(upto)), lists(term[head].view(np.int64), ends), lists(tf, ends)]
            out = pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "terms", "tf"])
            yield out.filter(pa.array(np.diff(upto) > 0))

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return in_batches(rows).mapInArrow(run, "doc_id bigint, n bigint, terms array<bigint>, tf array<bigint>")


def pack_items(weights: DataFrame, n_items: int) -> DataFrame:
    """Tiles (tile, part, entries, items, terms, row, col, w) of (item_id, term, w) rows: the weights of one tile of items."""
    rows = weights.withColumn("tile", F.pmod(F.xxhash64("item_id"), F.lit(max(1, -(-n_items // ITEMS)))).cast("int"))
    schema = "tile int, part int, entries bigint, items array<bigint>, terms array<bigint>, row array<int>, col array<int>, w array<bigint>"

    def pack(t: pa.Table) -> pa.Table:
        item, term, w = (t.column(c).to_numpy() for c in ("item_id", "term", "w"))
        ids = np.unique(item)
        out = []
        for a in range(0, len(ids), ITEMS):
            some = ids[a : a + ITEMS]
            mine = np.flatnonzero((item >= some[0]) & (item <= some[-1]))
            vocabulary, col = np.unique(term[mine], return_inverse=True)
            out.append({"tile": t.column("tile")[0].as_py(), "part": a // ITEMS, "entries": len(mine), "items": some, "terms": vocabulary,
                        "row": np.searchsorted(some, item[mine]), "col": col, "w": w[mine]})
        kind = pa.schema([("tile", pa.int32()), ("part", pa.int32()), ("entries", pa.int64()), ("items", pa.list_(pa.int64())),
                          ("terms", pa.list_(pa.int64())), ("row", pa.list_(pa.int32())), ("col", pa.list_(pa.int32())), ("w", pa.list_(pa.int64()))])
        return pa.Table.from_pylist(out, kind)

    return rows.groupBy("tile").applyInArrow(pack, schema)


class ItemTile:
    """Weights of a tile of items over their own vocabulary, and their best documents so far."""

    def __init__(self, row, k: int):
        self.items, self.terms = np.array(row["items"]), np.array(row["terms"], np.int64)
        self.row, self.col, self.w = (np.array(row[c]) for c in ("row", "col", "w"))
        self.k = k
        self.best = np.zeros((len(self.items), k), np.int64)
        self.docs = np.full((len(self.items), k), _NO_ID)

    def scores(self, terms: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int) -> np.ndarray:
        """items x documents, from the cells (term, doc, impact) of a tile of documents."""
        out = np.zeros((len(self.items), n_docs), np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        own = self.terms[at] == terms
        at, doc, impact = at[own], doc[own], impact[own]
        there = np.flatnonzero(np.bincount(at, minlength=len(self.terms)))  # terms that this tile of documents holds
        for a in range(0, len(there), TERMS):
            place = np.full(len(self.terms), -1)
            place[there[a : a + TERMS]] = np.arange(len(there[a : a + TERMS]))
            left, right = np.zeros((len(self.items), len(there[a : a + TERMS]))), np.zeros((len(there[a : a + TERMS]), n_docs))
            e, c = place[self.col] >= 0, place[at] >= 0
            left[self.row[e], place[self.col[e]]] = self.w[e]
            right[place[at[c]], doc[c]] = impact[c]
            out += (left @ right).astype(np.int64)
        return out

    def take(self, scores: np.ndarray, ids: np.ndarray):
        """Merges scores (items x documents) into the best; equal scores go to smaller ids."""
        least = np.maximum(self.best[:, -1:], 1)
        if scores.shape[1] > self.k:
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k][:, None])
        i, j = np.nonzero(scores >= least)
        if not len(i):
            return
        item = np.concatenate([np.repeat(np.arange(len(self.items)), self.k), i])
        s, d = np.concatenate([self.best.ravel(), scores[i, j]]), np.concatenate([self.docs.ravel(), ids[j]])
        order = np.lexsort((d, -s, item))
        head = np.searchsorted(item[order], np.arange(len(self.items)))
        order = order[head[:, None] + np.arange(self.k)]
        self.best, self.docs = s[order], d[order]


def search_tiles(cells: DataFrame, tiles: list, n_docs: int, n_terms: int, k: int = K) -> DataFrame:
    """(item_id, part, doc_id, score): the best ``k`` documents of each item in each task."""
    shared = cells.sparkSession.sparkContext.broadcast([r.asDict() for r in tiles])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = [ItemTile(r, k) for r in shared.value]
        for whole in batches:
            for a in range(0, whole.num_rows, DOCS):
                b = whole.slice(a, DOCS)
                count = b.column("terms").value_lengths().to_numpy()
                terms, tf = b.column("terms").flatten().to_numpy(), b.column("tf").flatten().to_numpy()
                doc = np.repeat(np.arange(b.num_rows), count)
                m = 10 + (90 * b.column("n").to_numpy() * n_docs) // n_terms
                impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
                ids = b.column("doc_id").to_numpy()
                for tile in plan:
                    tile.take(tile.scores(terms, doc, impact, b.num_rows), ids)
        for tile in plan:
            i, j = np.nonzero(tile.best > 0)
            yield pa.RecordBatch.from_arrays([pa.array(tile.items[i]), pa.array(tile.docs[i, j]), pa.array(tile.best[i, j])], names=["item_id", "doc_id", "score"])

    rows = cells.where("doc_id is not null and size(terms) > 0")
    return in_batches(rows).mapInArrow(run, "item_id bigint, doc_id bigint, score bigint")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = K, per_pass: int = PASS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of ``docs`` (doc_id, text) for each of ``items`` (item_id, text)."""
    asked = stored(item_terms(items), "item-terms")
    size = asked.agg(F.count_distinct("item_id").alias("items"), F.count_distinct("term").alias("terms")).first()
    cells = stored(document_cells(docs, *bit_table(asked.select("term").distinct(), "term", size["terms"])), "cells")
    whole = cells.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    held = cells.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    ratio = F.lit(float(2 * whole["docs"] + 2)) / (2 * F.col("df") + 1).cast("double")
    weights = asked.join(held, "term").select("item_id", "term", F.floor(1000 * F.log(ratio)).cast("bigint").alias("w"))
    tiles = stored(pack_items(weights, size["items"]), "item-tiles")
    groups, room = [], 0
    for r in tiles.select("tile", "part", "entries").orderBy("tile", "part").toLocalIterator():  # one row per tile of items
        if not groups or room + r["entries"] > per_pass:
            groups.append([])
            room = 0
        groups[-1].append((r["tile"], r["part"]))
        room += r["entries"]
    found = None
    for g in groups:
        first, last = (F.struct(F.lit(x[0]), F.lit(x[1])) for x in (g[0], g[-1]))
        mine = tiles.where(F.struct("tile", "part").between(first, last)).collect()
        best = search_tiles(cells, mine, whole["docs"], whole["terms"], k)
        found = best if found is None else found.union(best)
    if found is None:
        found = cells.sparkSession.createDataFrame([], "item_id bigint, doc_id bigint, score bigint")
    order = [F.col("score").desc(), F.col("doc_id")]
    spread = W.partitionBy("item_id", F.pmod(F.xxhash64("doc_id"), F.lit(64))).orderBy(*order)
    some = found.withColumn("r", F.row_number().over(spread)).where(F.col("r") <= k)
    best = some.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score")
