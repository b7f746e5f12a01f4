"""Operator 3: mixing sources to target weights by systematic sampling.

Sizes are words.  Sources in code point order, null last, weigh 3, 1, 2, repeating, and share ``share`` of all sizes; a
target stops at ``cap`` times its source's size and the excess goes to the others by weight until none is above.  A document's
expected copies are its source's target over its source's size.  Within a source the documents are put in order (by size, so
that takes stay close to targets), expected copies are summed along that order, one offset is added, and a document is
emitted once per integer boundary that its stretch crosses.

Expected copies are fixed-point integers, so sums do not depend on the order of addition, and orders and offsets are hashes of
ids and sources: reruns and repeated tasks agree.  The prefix sum has three levels, (size), (size, slice of the id's hash) and
row, each a window bounded by the distinct sizes, the slices, and a slice of the documents of one size; totals are combined
before the shuffle.  A source or a size that holds a third of all rows is thus spread over many tasks.

The table of sources has one row per source and is ordered in one task.  A null text has size 0; documents of a source of size 0
expect no copies; an empty table gives an empty result.  Repeated ids are separate documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import WORD, fresh_name, stored

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2.0
ONE = 1 << 24  #: fixed-point one; 10^11 documents of two copies stay below 2^63
SLICE_DIGITS = 3  #: 4096 slices


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target): one row per source of (source, size) rows."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").isNull(), F.col("source"))  # strings are compared as UTF-8, that is by code point
    rank = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank + 1).cast("int")))
    # sources reach their cap in the order of size over weight: those before the first that stays below are capped
    by_ratio = W.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    whole = by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    capped = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(cap)
    left = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    level = (F.sum("source_size").over(whole) * F.lit(share) - capped) / left
    per = per.withColumn("level", level)
    per = per.withColumn("fits", F.col("level") * F.col("w") < F.col("source_size") * F.lit(cap))
    final = F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(whole)
    target = F.least(F.coalesce(final * F.col("w"), F.col("source_size") * F.lit(cap)), F.col("source_size") * F.lit(cap))
    return per.select("source", "source_size", target.alias("target"))


def _hex(c: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, digits), 16, 10).cast("bigint")


def systematic_copies(docs: DataFrame, group: str, expected: str, order: str, key: str, seed: str = "mix") -> DataFrame:
    """``docs`` with ``copies``: ``expected`` copies per row rounded by systematic sampling within ``group``.

    ``order`` is a column of few distinct values that rows are put in order by, ``key`` breaks ties.
    """
    e = F.floor(F.greatest(F.coalesce(F.col(expected), F.lit(0.0)), F.lit(0.0)) * ONE).cast("bigint")
    rows = docs.withColumns({"_e": e, "_slice": F.coalesce(_hex(F.col(key).cast("string"), SLICE_DIGITS), F.lit(0))})
    rows = rows.withColumns({"_g": F.struct(F.col(group).isNull().alias("n"), F.coalesce(F.col(group), F.lit("")).alias("v"))})
    cells = rows.groupBy("_g", order, "_slice").agg(F.sum("_e").alias("_m"))
    per = cells.groupBy("_g", order).agg(F.sum("_m").alias("_m"))
    below = lambda w: F.coalesce(F.sum("_m").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per = per.select("_g", order, below(W.partitionBy("_g").orderBy(order)).alias("_b1"))
    cells = cells.select("_g", order, "_slice", below(W.partitionBy("_g", order).orderBy("_slice")).alias("_b2"))
    starts = cells.join(per, ["_g", order]).select("_g", order, "_slice", (F.col("_b1") + F.col("_b2")).alias("_start"))
    inside = W.partitionBy("_g", order, "_slice").orderBy(key).rowsBetween(W.unboundedPreceding, W.currentRow)
    offset = _hex(F.concat(F.lit(seed + "|"), F.col("_g.v")), 6)  # of the source, in [0, ONE)
    end = F.col("_start") + F.sum("_e").over(inside) + offset
    crossed = F.shiftright("_end", 24) - F.shiftright(F.col("_end") - F.col("_e"), 24)
    return rows.join(starts, ["_g", order, "_slice"]).withColumn("_end", end).withColumn("copies", crossed).drop(
        "_g", "_slice", "_e", "_start", "_end")


def mix_sizes(sized: DataFrame, key: str = "doc_id", weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = "mix") -> DataFrame:
    """Rows (``key``, source, size, further columns of the caller) with source_size, target, expected and copies."""
    targets = source_targets(sized.select("source", "size"), weights, share, cap).withColumnRenamed("source", "_source")
    rows = sized.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("expected", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    return systematic_copies(rows, "source", "expected", "size", key, seed)


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = "mix") -> DataFrame:
    """``docs`` (doc_id, text, source, any others) with size, source_size, target, expected and copies; ``F.sequence(1, copies)``
    explodes them.

    The rows are stored under a number first.  Sums, sorts and windows see numbers, sizes and sources; texts meet their copies
    once, at the end.  Further columns may have any names; those of the columns added are replaced.
    """
    made = ["size", "source_size", "target", "expected", "copies"]
    own = [c for c in docs.columns if c not in made]
    row = fresh_name(docs.columns, "row")
    rows = stored(docs.select(*own, F.monotonically_increasing_id().alias(row)), "mix-rows")
    narrow = rows.select(F.col(row).alias("row"), F.col("doc_id").alias("key"), "source", n_words(F.col("text")).alias("size"))
    got = mix_sizes(narrow, "key", weights, share, cap, seed)
    return rows.join(got.select(F.col("row").alias(row), *made), row).drop(row)
