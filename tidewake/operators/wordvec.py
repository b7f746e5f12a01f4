"""Word vectors by skip-gram with hierarchical softmax; the vectors of words and tree nodes stay in slices on the executors.

Words are numbered by falling count.  The lengths of a Huffman code depend on how many words have each count and on nothing else, so the
driver sees that histogram and keeps one number per code length.  Codes are canonical: length, code and tree nodes of a word follow from
its number.  Documents are dealt by a hash into blocks of about ``BLOCK`` tokens, and the blocks are met in turns, every block in one of
them.  In a turn a block asks the slices for the vectors of its words and of the nodes above them, goes once over its pairs of words
and sends the vectors back; a slice takes the mean of what its blocks made of a vector, as MLlib does for its partitions.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..session import drop_stored, stored
from .factor import _bytes, _read, _rows
from .grams import _kind
from .ordering import bucket_count

BLOCK, SLICE = 500_000, 1 << 20  #: tokens of a block, numbers of a slice
TURNS, MOST_TURNS, PER_TURN = 5, 40, 64  #: turns of a small table and of any, and blocks that a turn has before there are more turns
WINDOW, SENTENCE, RATE = 5, 1000, 0.025
STEP, BATCH = 16, 128  #: pairs of one word that stand together, and such groups that make one step
MOST = 32  #: pairs that move a vector in one step with their full rate


def lengths(words: dict[int, int]) -> np.ndarray:
    """How many code words of each length 0, 1, 2, .. a Huffman code has, from the number of words of each count."""
    heap = [(n, i, m) for i, (n, m) in enumerate(sorted(words.items()))]  # m nodes alike stand for one entry
    children: list[tuple[int, int] | None] = [None] * len(heap)
    heapq.heapify(heap)
    while heap:
        n, i, m = heapq.heappop(heap)
        if m == 1 and not heap:
            break
        if m > 1:
            made, pair, rest = (2 * n, m // 2), (i, i), (n, i, m % 2)
        else:
            n2, j, m2 = heapq.heappop(heap)
            made, pair, rest = (n + n2, 1), (i, j), (n2, j, m2 - 1)
        heapq.heappush(heap, (made[0], len(children), made[1]))
        children.append(pair)
        if rest[2]:
            heapq.heappush(heap, rest)
    depths = [Counter() for _ in children]
    out = Counter()
    if children:
        depths[-1][0] = 1
    for own, pair in zip(depths[::-1], children[::-1]):
        if pair is None:
            out.update(own)
        else:
            for c in pair:
                for d, m in own.items():
                    depths[c][d + 1] += m
    return np.array([out[d] for d in range(max(out, default=0) + 1)], np.int64)


def paths(ids: np.ndarray, num: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, nodes, bits): the numbers of the tree nodes above each word of ``ids``, from the root on, and the bits taken there."""
    first, inner, base = (np.zeros(len(num), np.int64) for _ in range(3))
    for d in range(len(num)):  # at each depth the leaves come first, then the nodes
        first[d] = 2 * (first[d - 1] + num[d - 1]) if d else 0
        inner[d] = (2 * inner[d - 1] if d else 1) - num[d]
        base[d] = base[d - 1] + inner[d - 1] if d else 0
    before = np.cumsum(num) - num
    size = np.searchsorted(np.cumsum(num), ids, "right")
    code = first[size] + ids - before[size]
    ends = np.concatenate([[0], np.cumsum(size)])
    depth = np.arange(ends[-1]) - np.repeat(ends[:-1], size)
    left = np.repeat(code, size)
    down = np.repeat(size, size) - depth
    nodes = base[depth] + (left >> down) - first[depth] - num[depth]
    return ends, nodes, (left >> (down - 1)) & 1


def pairs(codes: np.ndarray, ends: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray]:
    """(word, neighbour) of every word with those up to a random width of at most ``WINDOW`` around it; documents are cut at ``SENTENCE`` words."""
    size = np.diff(ends)
    at = np.arange(len(codes)) - np.repeat(ends[:-1], size)
    part = np.repeat(np.arange(len(size)), size) * (1 + size.max(initial=0) // SENTENCE) + at // SENTENCE
    width = rng.integers(1, WINDOW + 1, len(codes))
    a, b = [], []
    for o in range(1, WINDOW + 1):
        i = np.flatnonzero(part[o:] == part[:-o])
        ahead, back = i[width[i] >= o], i[width[i + o] >= o]
        a += [codes[ahead], codes[back + o]]
        b += [codes[ahead + o], codes[back]]
    return np.concatenate(a), np.concatenate(b)


def _add(x: np.ndarray, at: np.ndarray, step: np.ndarray, n: np.ndarray, rate: float) -> None:
    """Rows ``step`` times ``rate`` are added to the rows ``at`` of ``x``; a row that more than ``MOST`` pairs move takes their mean ``MOST`` times."""
    order = np.argsort(at, kind="stable")
    at = at.take(order)
    first = np.flatnonzero(np.diff(at, prepend=np.int32(-1)))
    less = rate * np.minimum(1, MOST / np.add.reduceat(n.take(order), first))
    x[at.take(first)] += np.add.reduceat(step.take(order, 0), first, axis=0) * less[:, None].astype(np.float32)
    x[-1] = 0


def train(word: np.ndarray, near: np.ndarray, ends: np.ndarray, nodes: np.ndarray, bits: np.ndarray, x: np.ndarray, y: np.ndarray, rate: tuple[float, float], rng) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of words and nodes after one pass over the pairs, from ``x`` and ``y``: up to ``STEP`` pairs of a word stand together, and ``BATCH`` such groups make one step."""
    x, y = (np.vstack([v, np.zeros((1, v.shape[1]), np.float32)]) for v in (x, y))  # the last row fills what is not there
    size = np.diff(ends)
    path, want = np.full((len(size), size.max(initial=0)), len(y) - 1, np.int32), np.zeros((len(size), size.max(initial=0)), np.float32)
    held = np.arange(path.shape[1]) < size[:, None]
    path[held], want[held] = nodes, 1 - bits
    order = rng.permutation(np.arange(len(word), dtype=np.int32))
    order = order[np.argsort(word[order], kind="stable")]
    word, near = word[order], np.r_[near[order], np.full(STEP, len(x) - 1)].astype(np.int32)
    begin = np.flatnonzero(np.diff(word, prepend=-1))
    many = np.diff(np.r_[begin, len(word)])
    groups = -(-many // STEP)
    start = np.repeat(begin, groups) + STEP * (np.arange(groups.sum()) - np.repeat(np.cumsum(groups) - groups, groups))
    own = np.minimum(STEP, np.repeat(begin + many, groups) - start)
    mixed = rng.permutation(len(start))
    one, across = np.ones(BATCH * STEP), np.arange(STEP)
    for b in range(0, len(mixed), BATCH):
        k = mixed[b : b + BATCH]
        w, n = word[start[k]], own[k]
        c = np.where(across < n[:, None], near[start[k][:, None] + across], np.int32(len(x) - 1))
        deep = size[w].max()
        p = path[w, :deep]
        u, v = x.take(c, 0), y.take(p, 0)
        g = u @ v.transpose(0, 2, 1)
        np.tanh(np.multiply(g, 0.5, out=g), out=g)  # 2 * sigmoid - 1
        np.subtract((want[w, None, :deep] - 0.5), np.multiply(g, 0.5, out=g), out=g)
        r = rate[0] + (rate[1] - rate[0]) * b / len(mixed)
        du, dv = g @ v, g.transpose(0, 2, 1) @ u
        _add(x, c.ravel(), du.reshape(-1, x.shape[1]), one[: c.size], r)
        _add(y, p.ravel(), dv.reshape(-1, x.shape[1]), np.repeat(n, deep).astype(float), r)
    return x[:-1], y[:-1]


def count_blocks(df: DataFrame, doc: str, tokens: str, blocks: int) -> DataFrame:
    """Stored (_b, docs, ends, codes, terms, n): the documents of each block as numbers of the block's terms, and their counts."""
    d = df.select(F.pmod(F.xxhash64(doc), F.lit(blocks)).cast("int").alias("_b"), doc, F.col(tokens).alias("_t"))

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        lists = t["_t"].combine_chunks()
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        words = lists.flatten().dictionary_encode()
        codes = words.indices.to_numpy().astype(np.int64)
        whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.table({"_b": pa.array([key[0].as_py()], pa.int32()), "docs": whole(t[doc].combine_chunks()), "ends": _bytes([np.concatenate([[0], np.cumsum(sizes)])]),
                         "codes": _bytes([codes.astype(_kind(len(words.dictionary)))]), "terms": whole(words.dictionary.cast(pa.string())),
                         "n": whole(pa.array(np.bincount(codes, minlength=len(words.dictionary))))})

    kind = dict(d.dtypes)[doc]
    return stored(d.groupBy("_b").applyInArrow(run, f"_b int, docs array<{kind}>, ends binary, codes binary, terms array<string>, n array<bigint>"))


def number_words(counted: DataFrame, min_count: int) -> tuple[DataFrame, np.ndarray]:
    """(stored (term, id), code words of each length): ids 0, 1, 2, .. by falling count."""
    words = counted.select(F.explode(F.arrays_zip("terms", "n")).alias("z")).groupBy(F.col("z.terms").alias("term")).agg(F.sum("z.n").alias("n")).where(F.col("n") >= min_count)
    words = stored(words.withColumn("_k", F.pmod(F.xxhash64("term"), F.lit(bucket_count(counted.sparkSession))).cast("int")))
    size = words.groupBy("n", "_k").agg(F.count(F.lit(1)).alias("_m"))
    held = size.groupBy("n").agg(F.sum("_m").alias("_m"))  # one row per count
    num = lengths({r["n"]: r["_m"] for r in held.collect()})
    before = (Window.unboundedPreceding, -1)
    above = held.select("n", F.coalesce(F.sum("_m").over(Window.partitionBy(F.lit(0)).orderBy(F.col("n").desc()).rowsBetween(*before)), F.lit(0)).alias("_a"))
    size = size.withColumn("_s", F.coalesce(F.sum("_m").over(Window.partitionBy("n").orderBy("_k").rowsBetween(*before)), F.lit(0))).join(above, "n")
    i = F.row_number().over(Window.partitionBy("n", "_k").orderBy("term")) - 1
    out = stored(words.withColumn("_i", i).join(size, ["n", "_k"]).select("term", (F.col("_a") + F.col("_s") + F.col("_i")).cast("bigint").alias("id")))
    drop_stored(words)
    return out, num


def place(counted: DataFrame, words: DataFrame, parts: int, turns: int) -> DataFrame:
    """Stored (_turn, _b, docs, ends, codes, ids, sizes): terms as ids, without words that have none; ``sizes`` are those of whole documents."""
    asked = counted.select("_b", F.posexplode("terms").alias("_i", "term")).join(words, "term").select(F.col("_b").alias("_at"), "_i", "id")
    kind = dict(counted.dtypes)["docs"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        r = left.select(["ends", "codes", "terms"]).to_pylist()[0]
        kind_of = _kind(len(r["terms"]))
        ends, codes = _read(r, "ends", np.int64), _read(r, "codes", kind_of)
        i, ids = right["_i"].to_numpy(), right["id"].to_numpy()
        order = np.argsort(ids)
        at = np.full(len(r["terms"]), -1)
        at[i[order]] = np.arange(len(order))
        held = at[codes] >= 0
        return pa.table({"_turn": pa.array([left["_b"][0].as_py() % turns], pa.int32()), "_b": left["_b"], "docs": left["docs"],
                         "ends": _bytes([np.concatenate([[0], np.cumsum(held)])[ends]]), "codes": _bytes([at[codes][held].astype(kind_of)]), "ids": _bytes([ids[order].astype(np.int64)]),
                         "sizes": _bytes([np.diff(ends)]), "wide": pa.array([np.dtype(kind_of).itemsize], pa.int32())})

    got = counted.drop("n").repartition(parts, "_b").groupBy("_b").cogroup(asked.repartition(parts, "_at").groupBy("_at")).applyInArrow(
        run, f"_turn int, _b int, docs {kind}, ends binary, codes binary, ids binary, sizes binary, wide int")
    return stored(got, "_turn")


def _block(left: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r = left.select(["ends", "codes", "ids", "wide"]).to_pylist()[0]
    return _read(r, "ends", np.int64), _read(r, "codes", np.dtype(f"u{r['wide']}")).astype(np.int64), _read(r, "ids", np.int64)


class WordVectors:
    """Vectors of words and of the nodes of their tree in slices (_s, x, y)."""

    def __init__(self, words: DataFrame, num: np.ndarray, size: int, seed=0):
        self.words, self.num, self.size, self.n_words, self.seed = words, num, size, int(num.sum()), seed
        self.slices = max(1, -(-self.n_words * size // SLICE))
        slices, n_words = self.slices, self.n_words

        def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in _rows(batches):
                s = r["id"]
                x = (np.random.default_rng((seed, s)).uniform(-0.5, 0.5, (len(range(s, n_words, slices)), size)) / size).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), _bytes([x]), _bytes([np.zeros_like(x)])], names=["_s", "x", "y"])

        self.table = stored(words.sparkSession.range(0, slices, 1, min(256, slices)).mapInArrow(start, "_s int, x binary, y binary"))

    def asked(self, blocks: DataFrame, parts: int, nodes: bool) -> DataFrame:
        """(_b, _s, x, y): vectors of a block's words and, with ``nodes``, of the nodes above them."""
        slices, num, size = self.slices, self.num, self.size

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in _rows(batches):
                ids = _read(r, "ids", np.int64)
                above = np.unique(paths(ids, num)[1]) if nodes else ids[:0]
                for s in range(slices):
                    own, up = ids[ids % slices == s], above[above % slices == s]
                    if len(own) or len(up):
                        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([r["_b"]], pa.int32()), _bytes([own]), _bytes([up])], names=["_s", "_b", "own", "up"])

        def reply(left: pa.Table, right: pa.Table) -> pa.Table:
            if not right.num_rows:
                return pa.table({"_b": pa.array([], pa.int32()), "_s": pa.array([], pa.int32()), "x": pa.array([], pa.binary()), "y": pa.array([], pa.binary())})
            x, y = (np.frombuffer(left[c][0].as_py(), np.float32).reshape(-1, size) for c in "xy")
            take = lambda v, c: _bytes(v[np.frombuffer(i, np.int64) // slices] for i in right[c].to_pylist())
            return pa.table({"_b": right["_b"], "_s": right["_s"], "x": take(x, "own"), "y": take(y, "up")})

        asks = blocks.select("_b", "ids").mapInArrow(ask, "_s int, _b int, own binary, up binary")
        n = min(256, slices)
        got = self.table.repartition(n, "_s").groupBy("_s").cogroup(asks.repartition(n, "_s").groupBy("_s")).applyInArrow(reply, "_b int, _s int, x binary, y binary")
        return got.repartition(parts, "_b")

    def _vectors(self, right: pa.Table, col: str, ids: np.ndarray) -> np.ndarray:
        out = np.zeros((len(ids), self.size), np.float32)
        for s, m in zip(right["_s"].to_pylist(), right[col].to_pylist()):
            if m:
                out[ids % self.slices == s] = np.frombuffer(m, np.float32).reshape(-1, self.size)
        return out

    def turn(self, blocks: DataFrame, parts: int, rate: tuple[float, float]) -> None:
        """One pass over the pairs of ``blocks`` while the rate falls."""
        slices, num, size, seed, read = self.slices, self.num, self.size, self.seed, _Plain(self)

        def learn(left: pa.Table, right: pa.Table) -> pa.Table:
            kinds = {"_s": pa.int32(), "own": pa.binary(), "x": pa.binary(), "up": pa.binary(), "y": pa.binary()}
            if not left.num_rows or not right.num_rows:
                return pa.table({c: pa.array([], t) for c, t in kinds.items()})
            ends, codes, ids = _block(left)
            rng = np.random.default_rng((seed, left["_b"][0].as_py()))
            word, near = pairs(codes.astype(np.int32), ends, rng)
            stops, nodes, bits = paths(ids, num)
            above, nodes = np.unique(nodes, return_inverse=True)
            x, y = read.vectors(right, "x", ids), read.vectors(right, "y", above)
            x, y = train(word, near, stops, nodes, bits, x, y, rate, rng)
            moved, led = np.unique(near), np.zeros(len(above), bool)
            met = np.zeros(len(ids), bool)
            met[word] = True
            led[nodes[np.repeat(met, np.diff(stops))]] = True
            own, x, up, y = ids[moved], x[moved], above[led], y[led]
            at = [(own % slices == s, up % slices == s) for s in range(slices)]
            return pa.table({"_s": pa.array(range(slices), pa.int32()), "own": _bytes(own[a] for a, _ in at), "x": _bytes(x[a] for a, _ in at),
                             "up": _bytes(up[b] for _, b in at), "y": _bytes(y[b] for _, b in at)})

        made = stored(blocks.repartition(parts, "_b").groupBy("_b").cogroup(self.asked(blocks, parts, True).groupBy("_b")).applyInArrow(
            learn, "_s int, own binary, x binary, up binary, y binary"))

        def mean(old: pa.ChunkedArray, ids: pa.ChunkedArray, new: pa.ChunkedArray) -> pa.Array:
            v = np.frombuffer(old[0].as_py(), np.float32).reshape(-1, size)
            total, n = np.zeros(v.shape), np.zeros(len(v))
            for i, m in zip(ids.to_pylist(), new.to_pylist()):
                at = np.frombuffer(i, np.int64) // slices
                total[at] += np.frombuffer(m, np.float32).reshape(-1, size)
                n[at] += 1
            return _bytes([np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], v).astype(np.float32)])

        def update(left: pa.Table, right: pa.Table) -> pa.Table:
            return pa.table({"_s": left["_s"], "x": mean(left["x"], right["own"], right["x"]), "y": mean(left["y"], right["up"], right["y"])})

        n, old = min(256, slices), self.table
        self.table = stored(old.repartition(n, "_s").groupBy("_s").cogroup(made.repartition(n, "_s").groupBy("_s")).applyInArrow(update, "_s int, x binary, y binary"))
        drop_stored(old)
        drop_stored(made)

    def vectors(self) -> DataFrame:
        """(term, vector)."""
        slices, size = self.slices, self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in _rows(batches):
                x = _read(r, "x", np.float32).reshape(-1, size)
                ids = r["_s"] + slices * np.arange(len(x))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(x.astype(float).tolist(), pa.list_(pa.float64()))], names=["id", "vector"])

        return self.table.select("_s", "x").mapInArrow(run, "id bigint, vector array<double>").join(self.words, "id").select("term", "vector")

    def mean_vectors(self, blocks: DataFrame, doc: str, parts: int, out: str) -> DataFrame:
        """(doc, mean of its words' vectors); words left out count as zeros, and a document without words is zero."""
        size, read = self.size, _Plain(self)
        kind = dict(blocks.dtypes)["docs"].removeprefix("array<").removesuffix(">")

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            docs = left["docs"].combine_chunks().flatten()
            if not left.num_rows:
                return pa.table({doc: docs, out: pa.array([], pa.list_(pa.float64()))})
            ends, codes, ids = _block(left)
            x = read.vectors(right, "x", ids).astype(float)
            own = np.repeat(np.arange(len(docs)), np.diff(ends))
            sums = np.stack([np.bincount(own, c[codes], len(docs)) for c in x.T], axis=1) if len(ids) else np.zeros((len(docs), size))
            sums /= np.maximum(_read({"n": left["sizes"][0].as_py()}, "n", np.int64), 1)[:, None]
            return pa.table({doc: docs, out: pa.array(sums.tolist(), pa.list_(pa.float64()))})

        return blocks.repartition(parts, "_b").groupBy("_b").cogroup(self.asked(blocks, parts, False).groupBy("_b")).applyInArrow(run, f"`{doc}` {kind}, `{out}` array<double>")


class _Plain:
    """What the tasks need of a ``WordVectors``; tables stay on the driver."""

    def __init__(self, of: WordVectors):
        self.size, self.slices = of.size, of.slices

    vectors = WordVectors._vectors


def fit_words(df: DataFrame, doc: str, tokens: str, size: int, min_count=1, turns: int | None = None, seed=0) -> tuple[WordVectors, DataFrame, int]:
    """(model, placed blocks, partitions for all of them)."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))  # rows hold whole blocks
    total = df.agg(F.sum(F.greatest(F.size(tokens), F.lit(0)).cast("bigint"))).first()[0] or 0
    turns = turns or min(MOST_TURNS, max(TURNS, -(-total // (BLOCK * PER_TURN))))
    blocks = max(turns, -(-total // BLOCK))
    counted = count_blocks(df, doc, tokens, blocks)
    words, num = number_words(counted, min_count)
    parts = min(256, 3 * blocks)
    placed = place(counted, words, parts, turns)
    drop_stored(counted)
    model = WordVectors(words, num, size, seed)
    for i in range(turns if model.n_words > 1 else 0):
        falling = tuple(RATE * max(1 - j / turns, 1e-4) for j in (i, i + 1))
        model.turn(placed.where(F.col("_turn") == i), min(256, 3 * -(-blocks // turns)), falling)
    return model, placed, parts
