"""Latent semantic vectors by a truncated singular value decomposition of a sparse table in long form.

The matrix has a row per document and a column per term.  Its cells are packed once into blocks of documents, each a few binary columns:
where a document ends, the term and the count of each cell in as few bytes as hold them, the weights of terms and documents.  The state
of the iteration is the columns of the documents, block by block, and their sums per term, in slices of the terms.  A step gives each
block the sums of its terms, makes its new columns and sends the sums of these to the slices.  Steps walk over groups of ``GROUP``
blocks, and what a group shuffles and sends goes before the next one starts, so besides the blocks themselves only the state grows with
the table.  Sums travel as 4-byte floats, columns stay 8-byte ones.  A term of one document only adds to that document's diagonal entry:
these terms, most of a vocabulary, are kept as one number per document, exactly.  The vocabulary may be of any size and never leaves
the executors.  Subspace iteration makes the columns orthonormal by the eigenvectors of their ``width`` x ``width`` Gram matrix.
Blocks add up their part of it, and these sums are the only numbers that reach the driver.  Iteration ends when the wanted singular
values settle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..session import drop_stored, stored
from .grams import _kind
from .textops import _cells

OVER = 16  #: columns beyond those wanted
STEPS = 2  #: products with the matrix and its transpose before the columns are made orthonormal again
ROUNDS, TOLERANCE = 30, 1e-4
CELLS = 1_500_000  #: cells of a block
GROUP, MOST_SLICES = 32, 256  #: blocks that a job of a step handles, and slices of the terms


def tfidf_cells(tf: DataFrame, doc: str, n_docs: Column) -> DataFrame:
    """(doc, term, w): counts times ln((1 + n) / (1 + df)) + 1, each document scaled to length 1."""
    df_ = tf.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    w = F.col("tf") * (F.ln((1 + n_docs) / (1 + F.col("_df"))) + 1)
    d = tf.join(df_, "term").select(doc, "term", w.alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc)))  # one document's terms
    return d.select(doc, "term", (F.col("w") / norm).alias("w"))


def _names(width: int) -> list[str]:
    return [f"v{i}" for i in range(width)]


def _bytes(arrays) -> pa.Array:
    return pa.array([np.ascontiguousarray(a).tobytes() for a in arrays], pa.binary())


def _read(row: dict, name: str, kind=np.float64) -> np.ndarray:
    return np.frombuffer(row[name], kind)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row at a time: rows hold whole blocks."""
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


BLOCK_SCHEMA = "_g int, _b int, ends binary, cols binary, n binary, kind string, of_term binary, of_doc binary, terms binary, lone binary"


def _packed(b: int, groups: int, slices: int, ends, cols, n, kind: str, ids, of_term, of_doc, lone, docs: pa.Array) -> pa.Table:
    """One block; ``ids`` are those of the terms, negative for the ones of one document, whose squares are in ``lone`` already."""
    held = ids[cols] >= 0
    order = np.lexsort((ids, ids % slices))  # a slice's terms stand together
    order = order[ids[order] >= 0]
    at = np.zeros(len(ids), _kind(len(order)))
    at[order] = np.arange(len(order))
    own = {"ends": np.concatenate([[0], np.cumsum(held)])[ends], "cols": at[cols[held]], "n": n[held].astype(kind), "of_term": of_term[order], "of_doc": of_doc, "terms": ids[order], "lone": lone}
    return pa.table({"_g": pa.array([b % groups], pa.int32()), "_b": pa.array([b], pa.int32()), "kind": [kind], **{c: _bytes([v]) for c, v in own.items()},
                     "docs": pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)})


def _kept(got: DataFrame, doc: str) -> tuple[DataFrame, DataFrame]:
    """Stored (blocks, (block, place, document))."""
    got = stored(got, "_g")
    places = stored(got.select("_b", F.posexplode("docs").alias("_i", doc)))
    blocks = got.drop("docs")
    blocks._stored = got._stored
    return blocks, places


def pack(cells: DataFrame, doc: str, slices: int, blocks: int) -> tuple[DataFrame, DataFrame]:
    """(blocks of cells, (block, place, document)) of (doc, term, w)."""
    shared = cells.groupBy("term").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("term", F.monotonically_increasing_id().alias("id"))
    block, groups = F.pmod(F.xxhash64(doc), F.lit(blocks)).cast("int"), -(-blocks // GROUP)
    d = cells.join(stored(shared), "term", "left").select(block.alias("_b"), F.col(doc).alias("_doc"), "id", "w")
    kind = dict(d.dtypes)["_doc"]

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        docs = t["_doc"].combine_chunks().dictionary_encode()
        order = pc.sort_indices(docs.dictionary).to_numpy()
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        i, w, ids = place[docs.indices.to_numpy()], t["w"].to_numpy(), pc.fill_null(t["id"].combine_chunks(), -1).to_numpy()
        lone = np.bincount(i[ids < 0], w[ids < 0] ** 2, len(order))
        by_doc = np.argsort(i, kind="stable")
        own, cols = np.unique(ids[by_doc], return_inverse=True)
        ends = np.searchsorted(i[by_doc], np.arange(len(order) + 1))
        return _packed(key[0].as_py(), groups, slices, ends, cols, w[by_doc], "<f8", own, np.ones(len(own)), np.ones(len(order)), lone, docs.dictionary.take(pa.array(order)))

    return _kept(d.groupBy("_b").applyInArrow(run, f"{BLOCK_SCHEMA}, docs array<{kind}>"), doc)


def count_cells(df: DataFrame, doc: str, tokens: Column, blocks: int, groups: int) -> DataFrame:
    """Stored (_g, _b, docs, ends, cols, n, kind, terms, seen): counted terms of each block; documents are dealt before they become tokens."""
    d = df.withColumn("_b", F.pmod(F.xxhash64(doc), F.lit(blocks)).cast("int")).repartition(min(2048, 2 * blocks), "_b").select("_b", doc, tokens.alias("_t"))
    kind = dict(d.dtypes)[doc]

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        docs, b = t[doc].combine_chunks(), key[0].as_py()
        terms, first, own, term, n = _cells(docs, t["_t"].combine_chunks(), False)
        small = np.dtype(_kind(n.max(initial=0) + 1)).str
        whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.table({"_g": pa.array([b % groups], pa.int32()), "_b": pa.array([b], pa.int32()), "docs": whole(docs.take(pa.array(first))), "ends": _bytes([np.searchsorted(own, np.arange(len(first) + 1))]),
                         "cols": _bytes([term.astype(_kind(len(terms)))]), "n": _bytes([n.astype(small)]), "kind": [small], "terms": whole(terms.cast(pa.string())),
                         "seen": whole(pa.array(np.bincount(term, minlength=len(terms)).astype(np.int32)))})

    return stored(d.groupBy("_b").applyInArrow(run, f"_g int, _b int, docs array<{kind}>, ends binary, cols binary, n binary, kind string, terms array<string>, seen array<int>"), "_g")


def pack_tokens(df: DataFrame, doc: str, tokens: Column, slices: int, blocks: int) -> tuple[list[DataFrame], DataFrame]:
    """As ``pack``, for the weights of ``tfidf_cells``, from token lists: a block sends each of its terms once.  One frame per group."""
    n_docs, groups = df.count(), -(-blocks // GROUP)
    counted = count_cells(df, doc, tokens, blocks, groups)
    terms = counted.select(F.explode(F.arrays_zip("terms", "seen")).alias("z")).groupBy(F.col("z.terms").alias("term")).agg(F.sum("z.seen").alias("df"))
    terms = stored(terms.where("df > 1").withColumn("id", F.monotonically_increasing_id()))
    kind = dict(counted.dtypes)["docs"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        r = left.select(["_b", "ends", "cols", "n", "kind"]).to_pylist()[0]
        count = len(left["terms"].combine_chunks().flatten())
        ends, cols, n = _read(r, "ends", np.int64), _read(r, "cols", _kind(count)), _read(r, "n", r["kind"])
        ids, seen, i = np.full(count, -1), np.ones(count), right["_i"].to_numpy()
        ids[i], seen[i] = right["id"].to_numpy(), right["df"].to_numpy()
        of_term = np.log((1 + n_docs) / (1 + seen)) + 1
        own = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        w2 = (n * of_term[cols]) ** 2
        square = np.bincount(own, w2, len(ends) - 1)
        of_doc = np.where(square > 0, 1 / np.sqrt(np.maximum(square, 1e-300)), 0.0)
        lone = np.bincount(own, np.where(ids[cols] < 0, w2, 0.0), len(ends) - 1) * of_doc**2
        return _packed(r["_b"], groups, slices, ends, cols, n, r["kind"], ids, of_term, of_doc, lone, left["docs"].combine_chunks().flatten())

    made = []
    for g in range(groups):
        part = counted.where(F.col("_g") == g)
        asked = part.select(F.col("_b").alias("_at"), F.posexplode("terms").alias("_i", "term")).join(terms, "term").select("_at", "_i", "id", "df")
        left, right = part.drop("_g", "seen").repartition(min(2 * GROUP, slices), "_b"), asked.repartition(min(2 * GROUP, slices), "_at")
        made.append(stored(left.groupBy("_b").cogroup(right.groupBy("_at")).applyInArrow(run, f"{BLOCK_SCHEMA}, docs {kind}")))
        drop_stored(_folder(counted, f"_g={g}", part))
    drop_stored(terms)
    places = stored(reduce(DataFrame.unionByName, [x.select("_b", F.posexplode("docs").alias("_i", doc)) for x in made]))
    return made, places


def _folder(of: DataFrame, name: str, part: DataFrame) -> DataFrame:
    """``part`` as the frame of a folder of the stored frame ``of``."""
    part._stored = f"{of._stored}/{name}"
    return part


STATE = "_x int, _s int, _b int, ids binary, m binary"  #: columns of a block (_x = 1), or its sums for a slice
_PARTS = ("_b", "ends", "cols", "n", "kind", "of_term", "of_doc", "terms", "lone")


def _cells_of(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of documents and terms, and counts, of a block's cells."""
    ends = _read(r, "ends", np.int64)
    return np.repeat(np.arange(len(ends) - 1), np.diff(ends)), _read(r, "cols", _kind(len(r["terms"]) // 8)).astype(np.int64), _read(r, "n", r["kind"]).astype(float)


def _state(r: dict, v: np.ndarray, slices: int, with_sums: bool) -> pa.Table:
    """Rows of the columns ``v`` of a block and, per slice, their sums over its cells."""
    terms, at, cut = _read(r, "terms", np.int64), [], []
    if with_sums:
        i, j, n = _cells_of(r)
        w = v * _read(r, "of_doc")
        sums = (np.stack([np.bincount(j, n * c[i], len(terms)) for c in w]) * _read(r, "of_term")).astype(np.float32)
        ends = np.searchsorted(terms % slices, np.arange(slices + 1))
        at = np.flatnonzero(np.diff(ends)).tolist()
        cut = [slice(ends[s], ends[s + 1]) for s in at]
    return pa.table({"_x": pa.array([1, *[0] * len(at)], pa.int32()), "_s": pa.array([-1, *at], pa.int32()), "_b": pa.array([r["_b"]] * (1 + len(at)), pa.int32()),
                     "ids": _bytes([terms[:0], *[terms[c] for c in cut]]), "m": _bytes([v, *[sums[:, c] for c in cut]])})


def begin(part: DataFrame, slices: int, width: int, seed: int) -> DataFrame:
    """State of random columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            yield from _state(r, np.random.default_rng((seed, r["_b"])).uniform(-0.5, 0.5, (width, len(r["lone"]) // 8)), slices, True).to_batches()

    return part.select(*_PARTS).mapInArrow(run, STATE)


def advance(part: DataFrame, x: DataFrame, totals: DataFrame, slices: int, width: int, m: np.ndarray, with_sums: bool) -> DataFrame:
    """State of the columns: the matrix times its transpose times the columns ``x``, whose sums are ``totals``, times ``m``."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            terms = _read(r, "terms", np.int64)
            ends = np.searchsorted(terms % slices, np.arange(slices + 1))
            at = np.flatnonzero(np.diff(ends))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([r["_b"]] * len(at), pa.int32()), _bytes(terms[ends[s] : ends[s + 1]] for s in at)], names=["_s", "_b", "ids"])

    def reply(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"_b": pa.array([], pa.int32()), "_s": pa.array([], pa.int32()), "m": pa.array([], pa.binary())})
        r = left.to_pylist()[0]
        ids, total = _read(r, "ids", np.int64), _read(r, "m").reshape(width, -1).astype(np.float32)
        return pa.table({"_b": right["_b"], "_s": right["_s"], "m": _bytes(total[:, np.searchsorted(ids, np.frombuffer(z, np.int64))] for z in right["ids"].to_pylist())})

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        r, got = left.to_pylist()[0], sorted(zip(right["_s"].to_pylist(), right["m"].to_pylist()))
        v = np.frombuffer(got[0][1]).reshape(width, -1)
        y = v * _read(r, "lone")
        if len(got) > 1:
            i, j, n = _cells_of(r)
            sums = np.concatenate([np.frombuffer(z, np.float32).reshape(width, -1) for _, z in got[1:]], axis=1) * _read(r, "of_term")
            y += np.stack([np.bincount(i, n * c[j], v.shape[1]) for c in sums]) * _read(r, "of_doc")
        return _state(r, m.T @ y, slices, with_sums)

    few = min(GROUP, slices)
    asks = part.select("_b", "terms").mapInArrow(ask, "_s int, _b int, ids binary")
    back = totals.repartition(few, "_s").groupBy("_s").cogroup(asks.repartition(few, "_s").groupBy("_s")).applyInArrow(reply, "_b int, _s int, m binary")
    back = back.unionByName(x.select("_b", F.lit(-1).alias("_s"), F.col("x").alias("m")))
    return part.select(*_PARTS).repartition(min(2 * GROUP, slices), "_b").groupBy("_b").cogroup(back.repartition(min(2 * GROUP, slices), "_b").groupBy("_b")).applyInArrow(meet, STATE)


def _take_in(states: Iterator[DataFrame], slices: int, width: int) -> tuple[list[DataFrame], DataFrame]:
    """(columns (_b, x) of each group, stored totals (_s, ids, m)): the sums of a group go once the totals have them."""

    def add(tables: list[pa.Table]) -> tuple[np.ndarray, np.ndarray]:
        ids, parts = [], []
        for t, kind in zip(tables, (np.float32, np.float64)):
            ids += [np.frombuffer(z, np.int64) for z in t["ids"].to_pylist()]
            parts += [np.frombuffer(z, kind).reshape(width, -1) for z in t["m"].to_pylist()]
        terms, at = np.unique(np.concatenate(ids), return_inverse=True)
        parts = np.concatenate(parts, axis=1)
        return terms, np.stack([np.bincount(at, c, len(terms)) for c in parts])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, m = add([left, right])
        return pa.table({"_s": pa.array([(left if left.num_rows else right)["_s"][0].as_py()], pa.int32()), "ids": _bytes([ids]), "m": _bytes([m])})

    columns, totals, few = [], None, min(GROUP, slices)
    for state in states:
        state = stored(state, "_x")
        x, sums = _folder(state, "_x=1", state.where("_x = 1").select("_b", F.col("m").alias("x"))), _folder(state, "_x=0", state.where("_x = 0").select("_s", "ids", "m"))
        old = totals if totals is not None else state.where("false").select("_s", "ids", "m")
        totals = stored(sums.repartition(few, "_s").groupBy("_s").cogroup(old.repartition(few, "_s").groupBy("_s")).applyInArrow(run, "_s int, ids binary, m binary"))
        drop_stored(sums)
        if len(columns):
            drop_stored(old)
        columns.append(x)
    return columns, totals


def gram(x: DataFrame, y: DataFrame, width: int) -> np.ndarray:
    """``width`` x ``width`` inner products of the columns of ``x`` and ``y``, made symmetric."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for r in _rows(batches):
            total += _read(r, "x").reshape(width, -1) @ _read(r, "y").reshape(width, -1).T
        yield pa.RecordBatch.from_pydict({"i": np.arange(width * width, dtype=np.int32), "v": total.ravel()})

    both = x.join(y.withColumnRenamed("x", "y"), "_b") if y is not x else x.withColumn("y", F.col("x"))
    got = both.select("x", "y").mapInArrow(add, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    g = np.zeros(width * width)
    for r in got:
        g[r["i"]] = r["v"]
    g = g.reshape(width, width)
    return (g + g.T) / 2


def turn(x: DataFrame, m: np.ndarray) -> DataFrame:
    """Columns times the matrix ``m``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            v = m.T @ _read(r, "x").reshape(m.shape[0], -1)
            yield pa.RecordBatch.from_arrays([pa.array([r["_b"]], pa.int32()), _bytes([v])], names=["_b", "x"])

    return x.select("_b", "x").mapInArrow(run, "_b int, x binary")


def unpack(x: DataFrame, width: int) -> DataFrame:
    """(block, place, v0 .. ) from blocks of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            v = _read(r, "x").reshape(width, -1)
            n = v.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r["_b"], np.int32)), pa.array(np.arange(n, dtype=np.int32)), *map(pa.array, v)], names=["_b", "_i", *_names(width)])

    return x.select("_b", "x").mapInArrow(run, "_b int, _i int, " + ", ".join(f"{v} double" for v in _names(width)))


def _whiten(g: np.ndarray) -> np.ndarray:
    """Turns columns with Gram matrix ``g`` into orthonormal ones; directions without weight become 0."""
    values, vectors = np.linalg.eigh(g)
    keep = values > max(values[-1], 0.0) * 1e-13
    return np.where(keep, vectors / np.sqrt(np.where(keep, values, 1.0)), 0.0)[:, ::-1]


def truncated_svd(cells: DataFrame, doc: str, k: int, over=OVER, rounds=ROUNDS, tolerance=TOLERANCE, seed=0) -> tuple[np.ndarray, DataFrame]:
    """(singular values, document rows U * S as v0 .. v{k-1}) of the matrix of (doc, term, w) cells.

    The sign of each direction is the one that makes the sum of its document column positive.
    """
    cells = stored(cells.select(doc, "term", "w"))
    count = max(1, -(-cells.count() // CELLS))
    slices = min(MOST_SLICES, 2 * count)
    blocks, places = pack(cells, doc, slices, count)
    drop_stored(cells)
    got = _decompose([blocks.where(F.col("_g") == g) for g in range(-(-count // GROUP))], places, doc, k, slices, over, rounds, tolerance, seed)
    drop_stored(blocks)
    return got


def _decompose(blocks: list[DataFrame], places: DataFrame, doc: str, k: int, slices: int, over=OVER, rounds=ROUNDS, tolerance=TOLERANCE, seed=0) -> tuple[np.ndarray, DataFrame]:
    """``truncated_svd`` of packed blocks, a frame per group."""
    width = k + over
    places.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))  # rows hold whole blocks
    whole = lambda parts: reduce(DataFrame.unionByName, parts)

    def step(columns: list[DataFrame], totals: DataFrame, m: np.ndarray, with_sums=True, keep=False) -> tuple[list[DataFrame], DataFrame]:
        made = (advance(part, x, totals, slices, width, m, with_sums) for part, x in zip(blocks, columns))
        new = _take_in(made, slices, width)
        for old in [*([] if keep else columns), totals]:
            drop_stored(old)
        return new

    x, totals = step(*_take_in((begin(part, slices, width, seed) for part in blocks), slices, width), np.eye(width))
    before = np.zeros(k)
    for _ in range(rounds):
        g = gram(whole(x), whole(x), width)
        m = _whiten(g)
        # after STEPS products with the matrix and its transpose the Gram matrix holds powers of the singular values
        values = np.maximum(np.linalg.eigvalsh(g)[::-1][:k], 0.0) ** (1 / (4 * STEPS))
        if np.abs(values - before).max(initial=0.0) <= tolerance * max(values[0], 1e-300):
            break
        before = values
        for _ in range(STEPS):
            x, totals = step(x, totals, m)
            m = np.eye(width)
    else:
        m = _whiten(gram(whole(x), whole(x), width))
    # the columns x times m are orthonormal; the matrix's part in their subspace
    y, none = step(x, totals, m, False, True)
    squares, vectors = np.linalg.eigh(gram(turn(whole(x), m), whole(y), width))
    values = np.sqrt(np.maximum(squares[::-1], 0.0))
    rows = unpack(turn(whole(x), m @ (vectors[:, ::-1][:, :k] * values[:k])), k)
    sums = rows.agg(*[F.sum(v).alias(v) for v in _names(k)]).first()
    signs = {v: -1.0 if (sums[v] or 0.0) < 0 else 1.0 for v in _names(k)}
    out = stored(rows.join(places, ["_b", "_i"]).select(doc, *[(F.col(v) * s).alias(v) for v, s in signs.items()]))
    for old in [*x, *y, none, places]:
        drop_stored(old)
    return values[:k], out


def lsa(tf: DataFrame, docs: DataFrame, doc: str, n_docs: Column, k=32, out="vector", **how) -> tuple[np.ndarray, DataFrame]:
    """(singular values, (doc, vector)) of TF-IDF weights, vectors of length 1; a document without terms has the zero vector."""
    values, rows = truncated_svd(tfidf_cells(tf, doc, n_docs), doc, k, **how)
    return values, _unit(rows, docs, doc, k, out)


def lsa_tokens(df: DataFrame, doc: str, tokens: Column, load: Column, k=32, out="vector", **how) -> tuple[np.ndarray, DataFrame]:
    """``lsa`` from token lists, without a table of cells.  ``load`` is about how many terms a document has; it sizes the blocks."""
    count = max(1, int(-(-(df.agg(F.sum(load.cast("double"))).first()[0] or 0) // CELLS)))
    slices = min(MOST_SLICES, 2 * count)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))  # rows hold whole blocks
    blocks, places = pack_tokens(df, doc, tokens, slices, count)
    values, rows = _decompose(blocks, places, doc, k, slices, **how)
    for b in blocks:
        drop_stored(b)
    return values, _unit(rows, df, doc, k, out)


def _unit(rows: DataFrame, docs: DataFrame, doc: str, k: int, out: str) -> DataFrame:
    v = F.array(*_names(k))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    unit = rows.select(doc, F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v).alias(out))
    none = F.array(*[F.lit(0.0)] * k)
    return docs.select(doc).join(unit, doc, "left").withColumn(out, F.coalesce(out, none))
