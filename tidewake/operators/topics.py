"""Topics by online variational Bayes; the topics x terms table stays in slices on the executors.

Documents are dealt by a hash into blocks of about ``BLOCK``, and each block counts its own terms once.  The blocks are met in ``TURNS``
turns, every block in one of them.  In a turn a block asks the slices for the weights of its terms, fits its documents and sends
back one sum per term; the slices take the sums in with a weight that falls from turn to turn.  What travels grows with the terms of
the blocks, each in one turn, and only totals per topic and per block reach the driver.  Several models, one per number of topics, are
fitted side by side over the same blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..session import drop_stored, stored
from .factor import _bytes, _read, _rows
from .ordering import bucket_count
from .textops import _cells

BLOCK, SLICE = 1024, 65_536
TURNS = 20
TAU, KAPPA = 1024, 0.51  #: the weight of a turn is (TAU + turn) ** -KAPPA
CLOSE = 1e-3  #: mean change of a document's topic counts at which its fit ends


def number_terms(terms: DataFrame) -> DataFrame:
    """``terms`` with ids 0, 1, 2, ...: terms are numbered inside hash buckets, which are shifted by the sizes of those before."""
    d = terms.withColumn("_k", F.pmod(F.xxhash64("term"), F.lit(bucket_count(terms.sparkSession))))
    d = d.withColumn("_i", F.row_number().over(Window.partitionBy("_k").orderBy("term")) - 1)
    before = Window.partitionBy(F.lit(0)).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    start = d.groupBy("_k").agg(F.count(F.lit(1)).alias("_n")).select("_k", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    return d.join(start, "_k").select(*terms.columns, (F.col("_s") + F.col("_i")).cast("int").alias("id"))


def digamma(x: np.ndarray) -> np.ndarray:
    """Shifted by 6, then the asymptotic series."""
    x, out = np.array(x, np.float64), np.zeros(np.shape(x))
    for _ in range(6):
        out -= 1 / x
        x = x + 1
    z = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132))))


def trigamma(x: np.ndarray) -> np.ndarray:
    x, out = np.array(x, np.float64), np.zeros(np.shape(x))
    for _ in range(6):
        out += 1 / (x * x)
        x = x + 1
    z = 1 / (x * x)
    return out + 1 / x + z / 2 + z / x * (1 / 6 - z * (1 / 30 - z * (1 / 42 - z / 30)))


def infer(ends: np.ndarray, cols: np.ndarray, n: np.ndarray, beta: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(topic counts per document, summed weights per term and topic) of one block; a document without terms keeps zeros."""
    gamma, sums = np.zeros((len(ends) - 1, len(alpha))), np.zeros(beta.shape)
    live = np.flatnonzero(np.diff(ends))
    g = np.ones((len(live), len(alpha)))
    theta = lambda x: np.exp(digamma(x) - digamma(x.sum(1))[:, None])
    own, b, w, term = np.repeat(np.arange(len(live)), np.diff(ends)[live]), beta[cols], n, cols
    while len(live):
        t = theta(g)
        ratio = w / (np.einsum("ij,ij->i", b, t[own]) + 1e-100)
        new = alpha + t * np.add.reduceat(b * ratio[:, None], np.flatnonzero(np.diff(own, prepend=-1)))
        far, g = np.abs(new - g).mean(1) > CLOSE, new
        if far.all() or 2 * far.sum() > len(live):
            continue
        # fitted documents leave once they are the half; what stays is packed anew
        gamma[live[~far]] = g[~far]
        done = ~far[own]
        t = theta(g)[own[done]]
        weight = (w[done] / (np.einsum("ij,ij->i", b[done], t) + 1e-100))[:, None] * t
        sums += np.stack([np.bincount(term[done], c, len(beta)) for c in weight.T], axis=1)
        live, g, keep = live[far], g[far], ~done
        own, b, w, term = (np.cumsum(far) - 1)[own[keep]], b[keep], w[keep], term[keep]
    return gamma, sums


def count_blocks(df: DataFrame, doc: str, tokens: str, blocks: int) -> DataFrame:
    """Stored (_b, docs, ends, cols, n, terms, seen): the counted terms of each block, and in how many of its documents each one is."""
    d = df.select(F.pmod(F.xxhash64(doc), F.lit(blocks)).cast("int").alias("_b"), doc, F.col(tokens).alias("_t"))

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        terms, first, own, term, n = _cells(t[doc].combine_chunks(), t["_t"].combine_chunks(), False)
        names, ends = t[doc].combine_chunks().take(pa.array(first)), np.searchsorted(own, np.arange(len(first) + 1))
        seen = pa.array(np.bincount(term, minlength=len(terms)))
        whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.table({"_b": pa.array([key[0].as_py()], pa.int32()), "docs": whole(names), "ends": _bytes([ends]), "cols": _bytes([term]),
                         "n": _bytes([n.astype(np.float64)]), "terms": whole(terms.cast(pa.string())), "seen": whole(seen)})

    kind = dict(d.dtypes)[doc]
    return stored(d.groupBy("_b").applyInArrow(run, f"_b int, docs array<{kind}>, ends binary, cols binary, n binary, terms array<string>, seen array<bigint>"))


def place(counted: DataFrame, terms: DataFrame, slices: int, idf_of: int | None, parts: int, turns: int = TURNS) -> DataFrame:
    """Stored (_turn, _b, docs, ends, cols, n, ids, spans): terms as ids, a slice's together; counts times IDF with ``idf_of`` documents."""
    asked = counted.select("_b", F.posexplode("terms").alias("_i", "term")).join(terms, "term").select(F.col("_b").alias("_at"), "_i", "id", "df")
    kind = dict(counted.dtypes)["docs"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        r = left.select(["ends", "cols", "n"]).to_pylist()[0]
        ends, cols, n = _read(r, "ends", np.int64), _read(r, "cols", np.int64), _read(r, "n")
        i, ids = right["_i"].to_numpy(), right["id"].to_numpy().astype(np.int64)
        order = np.lexsort((ids, ids % slices))
        at = np.full(max(1, cols.max(initial=0) + 1, i.max(initial=0) + 1), -1)
        at[i[order]] = np.arange(len(order))
        held = at[cols] >= 0
        ends, cols, n = np.concatenate([[0], np.cumsum(held)])[ends], at[cols][held], n[held]
        if idf_of is not None:
            n = n * np.log((idf_of + 1) / (right["df"].to_numpy()[order] + 1))[cols]
        spans = np.searchsorted(ids[order] % slices, np.arange(slices + 1))
        return pa.table({"_turn": pa.array([left["_b"][0].as_py() % turns], pa.int32()), "_b": left["_b"], "docs": left["docs"], "ends": _bytes([ends.astype(np.int64)]),
                         "cols": _bytes([cols.astype(np.int64)]), "n": _bytes([n]), "ids": _bytes([ids[order]]), "spans": _bytes([spans.astype(np.int64)])})

    # a number of partitions of one's own: blocks are few bytes and much work
    got = counted.drop("terms", "seen").repartition(parts, "_b").groupBy("_b").cogroup(asked.repartition(parts, "_at").groupBy("_at")).applyInArrow(
        run, f"_turn int, _b int, docs {kind}, ends binary, cols binary, n binary, ids binary, spans binary")
    return stored(got, "_turn")


class Topics:
    """Topics x terms tables of several models over one set of terms, in slices (_s, lam) of (terms, all topics)."""

    def __init__(self, spark, n_terms: int, ks: list[int], slices: int, seed=0):
        self.ks, self.n_terms, self.slices, self.width = list(ks), n_terms, slices, sum(ks)
        self.spans = [slice(int(z) - k, int(z)) for k, z in zip(self.ks, np.cumsum(self.ks))]
        self.alpha = [np.full(k, 1 / k) for k in self.ks]
        self.eta = np.repeat([1 / k for k in self.ks], self.ks)
        width = self.width

        def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in _rows(batches):
                lam = np.random.default_rng((seed, r["id"])).gamma(100, 1 / 100, (len(range(r["id"], n_terms, slices)), width))
                yield pa.RecordBatch.from_arrays([pa.array([r["id"]], pa.int32()), _bytes([lam]), pa.array([lam.sum(0).tolist()], pa.list_(pa.float64()))], names=["_s", "lam", "sums"])

        self._take(stored(spark.range(0, slices, 1, min(256, slices)).mapInArrow(start, "_s int, lam binary, sums array<double>")))

    def _take(self, lam: DataFrame) -> None:
        self.lam = lam
        got = lam.select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()  # one row per topic
        self.totals = np.zeros(self.width)
        for r in got:
            self.totals[r["i"]] = r["x"]

    def _asked(self, blocks: DataFrame, parts: int) -> DataFrame:
        """Blocks next to the weights of their terms: (_b, _s, m)."""
        width, slices, less = self.width, self.slices, digamma(self.totals)

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in _rows(batches):
                ids, spans = _read(r, "ids", np.int64), _read(r, "spans", np.int64)
                for s in np.flatnonzero(np.diff(spans)):
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([r["_b"]], pa.int32()), _bytes([ids[spans[s] : spans[s + 1]]])], names=["_s", "_b", "ids"])

        def reply(left: pa.Table, right: pa.Table) -> pa.Table:
            if not right.num_rows:
                return pa.table({"_b": pa.array([], pa.int32()), "_s": pa.array([], pa.int32()), "m": pa.array([], pa.binary())})
            beta = np.exp(digamma(np.frombuffer(left["lam"][0].as_py()).reshape(-1, width)) - less).astype(np.float32)
            return pa.table({"_b": right["_b"], "_s": right["_s"], "m": _bytes(beta[np.frombuffer(x, np.int64) // slices] for x in right["ids"].to_pylist())})

        asks = blocks.select("_b", "ids", "spans").mapInArrow(ask, "_s int, _b int, ids binary")
        n = min(256, slices)
        got = self.lam.select("_s", "lam").repartition(n, "_s").groupBy("_s").cogroup(asks.repartition(n, "_s").groupBy("_s")).applyInArrow(reply, "_b int, _s int, m binary")
        return got.repartition(parts, "_b")

    def _fit(self):
        """Function of a block and its replies: block row, and per model (topic counts, sums per term, weights of the terms)."""
        width, spans, alpha = self.width, self.spans, self.alpha

        def fit(left: pa.Table, right: pa.Table):
            r = left.select(["ends", "cols", "n", "ids", "spans"]).to_pylist()[0]
            got = sorted(zip(right["_s"].to_pylist(), right["m"].to_pylist()))
            beta = np.concatenate([np.zeros((0, width)), *[np.frombuffer(m, np.float32).reshape(-1, width) for _, m in got]])
            ends, cols, n = _read(r, "ends", np.int64), _read(r, "cols", np.int64), _read(r, "n")
            return r, beta, [infer(ends, cols, n, beta[:, x], a) for x, a in zip(spans, alpha)]

        return fit

    def turn(self, blocks: DataFrame, parts: int, docs: int, weight: float) -> None:
        """One turn over ``blocks``, taken in as if they stood for all ``docs``."""
        width, fit, slices, eta = self.width, self._fit(), self.slices, self.eta

        def expect(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return pa.table({"_s": pa.array([], pa.int32()), "ids": pa.array([], pa.binary()), "m": pa.array([], pa.binary()), "part": pa.array([], pa.list_(pa.float64()))})
            r, beta, got = fit(left, right)
            ids, spans = _read(r, "ids", np.int64), _read(r, "spans", np.int64)
            m = (np.concatenate([s for _, s in got], axis=1) * beta).astype(np.float32)
            some = got[0][0].any(1)
            logs = np.concatenate([(digamma(g[some]) - digamma(g[some].sum(1))[:, None]).sum(0) for g, _ in got])
            at = np.flatnonzero(np.diff(spans))
            cut = [slice(spans[s], spans[s + 1]) for s in at]
            return pa.table({"_s": pa.array([*at, -1], pa.int32()), "ids": _bytes([*[ids[c] for c in cut], ids[:0]]), "m": _bytes([*[m[c] for c in cut], m[:0]]),
                             "part": pa.array([*[None] * len(at), [*logs, float(some.sum())]], pa.list_(pa.float64()))})

        stats = stored(blocks.repartition(parts, "_b").groupBy("_b").cogroup(self._asked(blocks, parts).groupBy("_b")).applyInArrow(
            expect, "_s int, ids binary, m binary, part array<double>"))
        sums = np.zeros(width + 1)
        for x in stats.where("_s = -1").select("part").collect():  # one row per block
            sums += x["part"]
        met = sums[-1]
        if not met:
            drop_stored(stats)
            return

        def update(left: pa.Table, right: pa.Table) -> pa.Table:
            lam = np.frombuffer(left["lam"][0].as_py()).reshape(-1, width)
            add = np.zeros(lam.shape)
            for ids, m in zip(right["ids"].to_pylist(), right["m"].to_pylist()):
                add[np.frombuffer(ids, np.int64) // slices] += np.frombuffer(m, np.float32).reshape(-1, width)
            lam = (1 - weight) * lam + weight * (add * (docs / met) + eta)
            return pa.table({"_s": left["_s"], "lam": _bytes([lam]), "sums": pa.array([lam.sum(0).tolist()], pa.list_(pa.float64()))})

        n, old = min(256, slices), self.lam
        self._take(stored(old.select("_s", "lam").repartition(n, "_s").groupBy("_s").cogroup(stats.where("_s >= 0").repartition(n, "_s").groupBy("_s")).applyInArrow(
            update, "_s int, lam binary, sums array<double>")))
        drop_stored(old)
        drop_stored(stats)
        self.alpha = [self._prior(a, sums[x], met, weight) for a, x in zip(self.alpha, self.spans)]

    @staticmethod
    def _prior(alpha: np.ndarray, logs: np.ndarray, met: float, weight: float) -> np.ndarray:
        """A Newton step of the topics' prior, left out where it would leave the positive numbers."""
        slope = met * (digamma(alpha.sum()) - digamma(alpha)) + logs
        c, q = met * trigamma(alpha.sum()), -met * trigamma(alpha)
        b = (slope / q).sum() / (1 / c + (1 / q).sum())
        new = alpha - weight * (slope - b) / q
        return new if (new > 0).all() else alpha

    def mixtures(self, blocks: DataFrame, doc: str, parts: int) -> DataFrame:
        """(doc, mixtures): a list of topic shares per model; zeros for a document without known terms."""
        fit = self._fit()
        kind = dict(blocks.dtypes)["docs"].removeprefix("array<").removesuffix(">")

        def share(left: pa.Table, right: pa.Table) -> pa.Table:
            docs = left["docs"].combine_chunks().flatten()
            if not left.num_rows:
                return pa.table({doc: docs, "mixtures": pa.array([], pa.list_(pa.list_(pa.float64())))})
            _, _, got = fit(left, right)
            per = [(g / np.maximum(g.sum(1), 1e-300)[:, None]).tolist() for g, _ in got]
            return pa.table({doc: docs, "mixtures": pa.array([list(x) for x in zip(*per)], pa.list_(pa.list_(pa.float64())))})

        return blocks.repartition(parts, "_b").groupBy("_b").cogroup(self._asked(blocks, parts).groupBy("_b")).applyInArrow(share, f"`{doc}` {kind}, mixtures array<array<double>>")


class TopicModel:
    """Topics over all terms.  The terms stay a table (term, id, df), and topics are named by joins on term ids."""

    def __init__(self, terms: DataFrame, n_terms: int, docs: int, topics: Topics, tfidf: bool):
        self.terms, self.n_terms, self.docs, self.topics, self.tfidf = terms, n_terms, docs, topics, tfidf

    def transform(self, df, doc, tokens) -> DataFrame:
        """(doc, mixtures); terms not met in the fit are left out."""
        blocks = max(1, -(-df.count() // BLOCK))
        parts = min(256, 3 * blocks)
        placed = place(count_blocks(df, doc, tokens, blocks), self.terms, self.topics.slices, self.docs if self.tfidf else None, parts)
        return self.topics.mixtures(placed, doc, parts)


def fit_topics(df, doc, tokens, ks, tfidf=False, turns=TURNS, seed=0) -> TopicModel:
    """A model per number of topics in ``ks``, on counts (or TF-IDF weights) of all terms; each turn meets its own share of the blocks."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))  # rows hold whole blocks
    docs = df.count()
    blocks = max(turns, -(-docs // BLOCK))
    counted = count_blocks(df, doc, tokens, blocks)
    terms = counted.select(F.explode(F.arrays_zip("terms", "seen")).alias("z")).groupBy(F.col("z.terms").alias("term")).agg(F.sum("z.seen").alias("df"))
    terms = stored(number_terms(terms))
    n_terms = terms.count()
    slices = max(1, -(-n_terms // SLICE))
    placed = place(counted, terms, slices, docs if tfidf else None, min(256, 3 * blocks), turns)
    drop_stored(counted)
    topics = Topics(spark, n_terms, ks, slices, seed)
    parts = min(256, 3 * -(-blocks // turns))
    for i in range(turns):
        topics.turn(placed.where(F.col("_turn") == i), parts, docs, (TAU + i + 1) ** -KAPPA)
    return TopicModel(terms, n_terms, docs, topics, tfidf)


def best_terms(model: TopicModel, n: int) -> DataFrame:
    """(model, topic, rank, term, weight) of each model's topics; rank 0 is the weakest of the n words, ties to the smaller id."""
    t = model.topics
    width, slices, totals = t.width, t.slices, t.totals
    named = [(m, i) for m, k in enumerate(t.ks) for i in range(k)]

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            p = _read(r, "lam").reshape(-1, width) / totals
            for (m, i), c in zip(named, p.T):
                at = np.argsort(-c, kind="stable")[:n]
                yield pa.RecordBatch.from_pydict({"model": pa.array([m] * len(at), pa.int32()), "topic": pa.array([i] * len(at), pa.int32()),
                                                  "id": pa.array((r["_s"] + slices * at).astype(np.int32)), "weight": pa.array(c[at])})

    d = t.lam.select("_s", "lam").mapInArrow(top, "model int, topic int, id int, weight double")
    w = Window.partitionBy("model", "topic").orderBy(F.col("weight").desc(), "id")  # n rows per slice
    d = d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return d.withColumn("rank", F.lit(n) - F.col("_r")).join(model.terms, "id").select("model", "topic", "rank", "term", "weight")
