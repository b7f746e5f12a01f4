"""Operator 13: benchmark decontamination by a prefix-filtered set join.

Words are the maximal runs of digits, ASCII letters and characters beyond ASCII, A-Z in lower case.  A window is ``WINDOW``
consecutive words of an item; an item of fewer words is one window.  A document holds a window if its words occur in a row; words
inside any such occurrence are hit.

A window is the set of its shingles of ``SHINGLE`` words with their places (a shorter window is one shingle).  It is contained in a
stretch of a document of its size exactly if all its shingles are, so the wanted similarity is 1 and the necessary prefix is a
single shingle, whatever the order of shingles:

1. One pass over the documents finds the shingles that may belong to an item, by a bit table of at most 8 MB.  Shingles whose words
   overlap or touch are a *run*; no occurrence crosses runs and runs share no words, so documents with one passage share one run:
   a run is stored and joined once, however many documents hold it.
2. Shingles are ordered by rarity, the number of documents' runs that hold them.  Windows with a shingle that no run holds are
   dropped; of the others the rarest shingle is the prefix.
3. Runs meet windows by prefix shingles.  The window must start inside the run and end inside it (positional and length bounds).
4. Every shingle of the window must stand at its place of the run.  What is left are the occurrences.

Hit words and items are worked out per distinct run and added up per document.  Nothing is collected but the bit table.

A null or empty text has no words and no hits.  Repeated rows are documents of their own.  Benchmark rows that share an id are one
item; rows without an id or without words have no windows.  Shingles are compared by 64-bit fingerprints, runs by 128 bits.  Texts
are used whole; an empty benchmark leaves all documents clean; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import in_batches, row_slices, stored
from .terms import SLICE_BYTES, bit_table, lists, may_hold, shingle_prints, word_prints

WINDOW, SHINGLE = 10, 5


def item_windows(items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item_id, n, shingles): the distinct windows of each item as number of words and fingerprints in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches, "text", SLICE_BYTES):
            prints, upto = word_prints(b.column("text"))
            rows = []
            for item, first, stop in zip(b.column("item_id").to_pylist(), upto.tolist(), upto[1:].tolist()):
                n = min(window, stop - first)
                if n:
                    s = shingle_prints(prints[first:stop], min(n, shingle)).view(np.int64)
                    each = n - min(n, shingle) + 1
                    rows += [(item, n, s[i : i + each]) for i in range(len(s) - each + 1)]
            ends = np.cumsum([0, *[len(r[2]) for r in rows]])
            flat = np.concatenate([r[2] for r in rows]) if rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), lists(flat, ends)],
                                             names=["item_id", "n", "shingles"])

    rows = items.select(F.col(key).cast("bigint").alias("item_id"), F.col(text).alias("text")).where("item_id is not null")
    return in_batches(rows).mapInArrow(run, "item_id bigint, n int, shingles array<bigint>").distinct()


def document_runs(docs: DataFrame, sizes: list[int], table: np.ndarray, bits: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, n_words, runs): ``runs`` are (id, at, print), the shingles of a run by their place and fingerprint."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    kind = pa.list_(pa.struct([("id", pa.string()), ("at", pa.list_(pa.int32())), ("print", pa.list_(pa.int64()))]))

    def found(prints, upto):
        """Places, sizes and fingerprints of the shingles that may count, in the order of places."""
        at, size, what = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for n in sizes:
            s = shingle_prints(prints, n)
            hits = may_hold(shared.value, bits, s)
            hits = hits[np.searchsorted(upto, hits, "right") == np.searchsorted(upto, hits + n - 1, "right")]  # inside one text
            at.append(hits)
            size.append(np.full(len(hits), n))
            what.append(s[hits])
        at, size, what = np.concatenate(at), np.concatenate(size), np.concatenate(what)
        order = np.lexsort((size, at))
        return at[order], size[order], what[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches, "text", SLICE_BYTES):
            prints, upto = word_prints(b.column("text"))
            at, size, what = found(prints, upto)
            doc = np.searchsorted(upto, at, "right") - 1
            runs = [[] for _ in range(b.num_rows)]
            if len(at):
                end = np.maximum.accumulate(at + size)
                new = np.ones(len(at), bool)
                new[1:] = (at[1:] > end[:-1]) | (doc[1:] != doc[:-1])
                head = np.flatnonzero(new)
                for i, j in zip(head, np.append(head[1:], len(at))):
                    place, p = (at[i:j] - at[i]).astype(np.int32), what[i:j].view(np.int64)
                    name = xxhash.xxh3_128_hexdigest(place.tobytes() + p.tobytes())
                    runs[doc[i]].append({"id": name, "at": place, "print": p})
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(upto)), pa.array(runs, kind)], names=["doc_id", "n_words", "runs"])

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    made = in_batches(rows).mapInArrow(run, "doc_id bigint, n_words bigint, runs array<struct<id:string,at:array<int>,print:array<bigint>>>")
    return made.withColumn("row", F.monotonically_increasing_id())


def occurrences(runs: DataFrame, windows: DataFrame) -> DataFrame:
    """(id, win, n, start): windows that the runs (id, docs, at, print) hold, by a prefix-filtered join."""
    held = runs.select("id", "docs", F.explode(F.arrays_zip("at", "print")).alias("s")).select("id", "docs", "s.at", "s.print")
    rarity = held.groupBy("print").agg(F.sum("docs").alias("df"))
    each = windows.select("win", "n", F.posexplode("shingles").alias("i", "print")).join(rarity, "print", "left")
    prefix = each.groupBy("win", "n").agg(F.min(F.struct("df", "print", "i")).alias("p"), F.bool_and(F.col("df").isNotNull()).alias("all"))
    prefix = prefix.where("all").select("win", "n", F.col("p.print").alias("print"), "p.i")
    met = held.select("id", "at", "print").join(prefix, "print").select("id", "win", "n", (F.col("at") - F.col("i")).alias("start")).where("start >= 0")
    # the window's shingles, each at its place of the run
    wanted = met.join(windows.select("win", "shingles"), "win").select("id", "win", "n", "start", F.size("shingles").alias("all"), F.posexplode("shingles").alias("i", "print"))
    wanted = wanted.withColumn("at", F.col("start") + F.col("i"))
    there = wanted.join(held.select("id", "at", "print").distinct(), ["id", "at", "print"])
    return there.groupBy("id", "win", "n", "start").agg(F.count(F.lit(1)).alias("found"), F.first("all").alias("all")).where("found = all").drop("found", "all")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_words, n_hit, items): one row for each of ``docs`` (doc_id, text), with the ids of the items found, ascending."""
    asked = stored(item_windows(items, window=window, shingle=shingle), "item-windows")
    sizes = [r["n"] for r in asked.select(F.least("n", F.lit(shingle)).alias("n")).distinct().orderBy("n").collect()]  # at most ``shingle``
    prints = asked.select(F.explode("shingles").alias("print")).distinct()
    table, bits = bit_table(prints, "print", prints.count())
    found = stored(document_runs(docs, sizes, table, bits), "document-runs")

    named = asked.withColumn("win", F.xxhash64("n", "shingles"))
    windows = named.groupBy("win").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))
    each = found.where("size(runs) > 0").select("row", F.explode("runs").alias("r"))
    runs = stored(each.groupBy(F.col("r.id").alias("id")).agg(F.count(F.lit(1)).alias("docs"), F.first("r.at").alias("at"), F.first("r.print").alias("print")), "runs")
    held = stored(occurrences(runs, windows), "occurrences")
    words = held.select("id", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("at")).distinct()
    words = words.groupBy("id").agg(F.count(F.lit(1)).alias("n_hit"))
    which = held.select("id", "win").distinct().join(named.select("win", "item_id"), "win")
    which = which.groupBy("id").agg(F.collect_set("item_id").alias("items"))
    hit = stored(words.join(which, "id"), "hit-runs")
    per = each.select("row", F.col("r.id").alias("id")).join(hit, "id").groupBy("row").agg(
        F.sum("n_hit").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    out = found.select("row", "doc_id", "n_words").join(per, "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<bigint>")).alias("items"))
