"""Operator 9: exact Jaccard join of word n-gram sets by signature trees.

*Candidates.*  Documents with equal sets are one node.  Two sets of the wanted similarity share a token among the first
``|x| - ceil(t |x|) + 1`` of each, whatever the common order of tokens; the order puts tokens that many documents hold last (by
a histogram of token hashes of fixed size, taken over all documents), so passages and lines that many documents share seldom
bring unrelated documents together.  Nodes that share a prefix token form a group.

*Groups.*  First every node goes to the group of its most popular prefix token, which joins most copies with one comparison
group per node.  Then the tokens are taken whose nodes are neither all of one component nor all from one finished group; tokens
with the same nodes are one group.  A group of more than ``max_group`` nodes is split by a hash: in the first step into parts
that share a leader, in the second into all pairs of parts, so no task holds an unbounded group and no link is lost.

*Signature trees.*  Within a group, sets are leaves with a bitmap of ``TOKEN_BITS`` to twice as many bits a token, a power of two in
all, so sets of one size class have one length and a longer bitmap is folded to meet a shorter one.  Inner nodes hold the OR of
their bitmaps, the range of sizes and the largest number of tokens that a leaf has beyond its bits.  Trees of equal and of
neighbouring classes are descended together: a pair of nodes is dropped if the common bits plus that excess, or the size ranges,
rule out the wanted overlap, or if both lie in one component already.  Leaf pairs that are left are decided on the whole sets.  In
the second step only bitmaps and sizes move to the groups; they say which members have a possible partner, and the texts of these
alone follow, to be decided where they meet.  Only a spanning forest of the links is given out: rows grow with the members of a
group, never with its pairs, and the components are whole.

A null text, or one without words, has an empty set and is linked with nothing.  A text with fewer than ``n`` words has its
whole sequence as one shingle.  Rows with a null id belong to no component (null).  Repeated rows are copies of each other.
Tokens and sets are compared by 64- and 128-bit fingerprints.  Empty tables and further columns are allowed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import in_batches, map_arrow, mix64, release, row_slices, stored
from .graph import connected_components

N = 5
PERCENT = 75
CELL_BITS = 20  #: cells of the token histogram
BLOCK_CELLS = 1 << 14
TOKEN_BITS = 4
FAN = 8
MAX_GROUP = 1000
LARGE_GROUP = 8 << 20  #: bytes of texts after which a worker gives memory back
SLICE_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE = np.random.default_rng(9).integers(0, 1 << 64, 256, dtype=np.uint64)[_LOWER]  # upper case counts as lower case


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64 (an odd number has one)."""
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words of several texts in UTF-8, and the text that each belongs to."""
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)  # a blank ends every text
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    blank = _BLANK[data]
    before = np.concatenate([[True], blank[:-1]])
    start, end = np.flatnonzero(before & ~blank), np.flatnonzero(~before & blank)
    power, inverse = _powers(max(1 << 20, 1 << len(data).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power[: len(data)])])
    h = mix64((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    edges = np.cumsum([len(r) + 1 for r in raw])
    return h, np.searchsorted(edges, start, "right")


def shingle_sets(texts: list[str | None], n: int = N) -> list[np.ndarray]:
    """Ascending distinct fingerprints of the n-word shingles of each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    w, own = word_hashes(raw)
    base = np.uint64(_BASE)
    h = np.zeros(max(0, len(w) - n + 1), np.uint64)
    for i in range(n):
        h = mix64(h * base + w[i : len(w) - n + 1 + i]) if len(h) else h
    first, stop = np.searchsorted(own, np.arange(len(raw))), np.searchsorted(own, np.arange(len(raw)), "right")
    out = []
    for a, b in zip(first.tolist(), stop.tolist()):
        if b - a >= n:
            out.append(np.unique(h[a : b - n + 1]))
        elif b > a:  # the whole sequence is one shingle
            x = np.array([b - a], np.uint64)
            for i in range(a, b):
                x = mix64(x * base + w[i : i + 1])
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_set(text: str | None, n: int = N) -> np.ndarray:
    return shingle_sets([text], n)[0]


def _set_hash(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)


def bitmap(s: np.ndarray) -> np.ndarray:
    """Token bitmap of a set; halves of it OR-ed together are the bitmap of half the length."""
    words = 1 << max(0, -(-TOKEN_BITS * len(s) // 64) - 1).bit_length()
    at = (s * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(24)) & np.uint64(64 * words - 1)
    bits = np.zeros(words, np.uint64)
    np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return bits


def describe_sets(docs: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, size, h1, h2, bits) per document, and the partial token histograms of tasks as (block, counts) rows."""
    cells, blocks = 1 << CELL_BITS, (1 << CELL_BITS) // BLOCK_CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(cells, np.int64)
        names = ["doc_id", "size", "h1", "h2", "bits", "block", "counts"]
        none = lambda k, t: pa.nulls(k, t)
        for b in row_slices(batches, "text", SLICE_BYTES):
            sets = shingle_sets(b.column("text").to_pylist(), n)
            rows = [(len(s), *_set_hash(s)) for s in sets]
            at, found = np.unique(np.concatenate(sets) >> np.uint64(64 - CELL_BITS), return_counts=True)
            seen[at.astype(np.int64)] += found
            k = len(rows)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array([r[i] for r in rows], pa.int64()) for i in range(3)],
                 pa.array([bitmap(x).tobytes() for x in sets], pa.binary()), none(k, pa.int32()), none(k, pa.binary())], names=names)
        if seen.any():
            parts = np.minimum(seen, 0xFFFFFFFF).astype(np.uint32).reshape(blocks, -1)
            yield pa.RecordBatch.from_arrays(
                [*[none(blocks, pa.int64())] * 4, none(blocks, pa.binary()), pa.array(range(blocks), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=names)

    return map_arrow(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id bigint, size bigint, h1 bigint, h2 bigint, bits binary, block int, counts binary")


def token_classes(parts: DataFrame) -> np.ndarray:
    """log2 class of each cell of the token histogram: a table of fixed size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column("block").to_pylist(), b.column("counts").to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(c, np.uint32).astype(np.int64)
        classes = {k: np.frompyfunc(int.bit_length, 1, 1)(v.tolist()).astype(np.uint8) for k, v in total.items()}
        yield pa.RecordBatch.from_arrays([pa.array(list(classes), pa.int32()), pa.array([v.tobytes() for v in classes.values()], pa.binary())],
                                         names=["block", "classes"])

    out = np.zeros(1 << CELL_BITS, np.uint8)
    for k, c in in_batches(parts.repartition("block")).mapInArrow(add, "block int, classes binary").collect():
        out[k * BLOCK_CELLS : (k + 1) * BLOCK_CELLS] = np.frombuffer(c, np.uint8)
    return out


def prefix_tokens(docs: DataFrame, classes: np.ndarray, percent: int = PERCENT, n: int = N) -> DataFrame:
    """(token, node): the prefix of each set; node is the set's fingerprint."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in row_slices(batches, "text", SLICE_BYTES):
            tokens, nodes = [], []
            for s in shingle_sets(b.column("text").to_pylist(), n):
                if len(s):
                    k = len(s) + (-percent * len(s)) // 100 + 1  # |x| - ceil(t |x|) + 1
                    order = np.lexsort((s, table[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)]))[:k]
                    tokens.append(s[order])
                    nodes.append(np.full(k, _set_hash(s)[0], np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(nodes))], names=["token", "node"])

    return map_arrow(docs.select("text"), run, "token bigint, node bigint")


class _Forest:
    """Union-find over the sets of a group; labels are the smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int):
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)

    def labels(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.up))])


class SignatureTree:
    """Levels of nodes over ordered leaves of one bitmap length, leaves first; an inner node covers ``FAN`` nodes below it."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, labels: np.ndarray):
        excess = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, sizes, sizes, excess, labels)]
        while len(self.levels[-1][1]) > 1:
            b, lo, hi, ex, lab = self.levels[-1]
            start = np.arange(0, len(lo), FAN)
            one, other = np.minimum.reduceat(lab, start), np.maximum.reduceat(lab, start)
            self.levels.append((np.bitwise_or.reduceat(b, start), np.minimum.reduceat(lo, start), np.maximum.reduceat(hi, start),
                                np.maximum.reduceat(ex, start), np.where(one == other, one, -1)))  # -1: several components below

    def level(self, i: int):
        return self.levels[min(i, len(self.levels) - 1)]

    def meet(self, other: SignatureTree, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Leaf pairs of different labels that neither bits nor sizes rule out; i < j where a tree meets itself."""
        i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for level in range(max(len(self.levels), len(other.levels)) - 1, -1, -1):
            bits, lo, hi, ex, lab = self.level(level)
            bits2, lo2, hi2, ex2, lab2 = other.level(level)
            keep, step = [np.zeros(0, bool)], max(1, (1 << 20) // bits.shape[1])
            for s in range(0, len(i), step):
                a, b = i[s : s + step], j[s : s + step]
                need = -(-percent * (lo[a] + lo2[b]) // (100 + percent))
                can = (100 * hi[a] >= percent * lo2[b]) & (100 * hi2[b] >= percent * lo[a]) & ((lab[a] < 0) | (lab[a] != lab2[b]))
                at = np.flatnonzero(can)
                common = np.bitwise_count(bits[a[at]] & bits2[b[at]]).sum(axis=1, dtype=np.int64)
                can[at] = common + np.minimum(ex[a[at]], ex2[b[at]]) >= need[at]
                keep.append(can)
            keep = np.concatenate(keep)
            i, j = i[keep], j[keep]
            if level:
                kid = np.arange(FAN)
                a = (i[:, None, None] * FAN + kid[None, :, None] + 0 * kid[None, None, :]).ravel()
                b = (j[:, None, None] * FAN + kid[None, None, :] + 0 * kid[None, :, None]).ravel()
                ok = (a < len(self.level(level - 1)[1])) & (b < len(other.level(level - 1)[1]))
                if self is other:
                    ok &= a <= b if level > 1 else a < b
                i, j = a[ok], b[ok]
        return (i, j) if self is not other or len(self.levels) > 1 else (i[:0], j[:0])


def possible_pairs(bits: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets with different labels that may be linked, by trees of bitmap lengths; sets are in the order of their size."""
    lengths = np.array([len(b) for b in bits])
    places = {int(w): np.flatnonzero(lengths == w) for w in np.unique(lengths)}
    tree = lambda at, m: SignatureTree(m, sizes[at], labels[at])
    first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for w, at in places.items():
        mine = np.stack([bits[x] for x in at])
        own = tree(at, mine)
        for w2, there in places.items():
            if w2 < w or 100 * sizes[at].max() < percent * sizes[there].min():
                continue
            if w2 == w:
                i, j = own.meet(own, percent)
            else:
                folded = np.bitwise_or.reduce(np.stack([bits[x] for x in there]).reshape(len(there), w2 // w, w), axis=1)
                i, j = own.meet(tree(there, folded), percent)
            first.append(at[i])
            second.append(there[j])
    return np.concatenate(first), np.concatenate(second)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether 100 * intersection >= percent * union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def join_group(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Component label (an index) of each set of a group."""
    n = len(sets)
    low = np.array([s[0] for s in sets])
    order = np.lexsort((low, [len(s) for s in sets]))
    sets = [sets[i] for i in order]
    forest = _Forest(n)
    for i in range(1, n):  # neighbours in order and the first: joins most of a group of copies
        for j in {i - 1, 0}:
            if forest.find(i) != forest.find(j) and linked(sets[i], sets[j], percent):
                forest.join(i, j)
    pairs = possible_pairs([bitmap(s) for s in sets], np.array([len(s) for s in sets], np.int64), forest.labels(), percent)
    for a, b in zip(*[x.tolist() for x in pairs]):
        if forest.find(a) != forest.find(b) and linked(sets[a], sets[b], percent):
            forest.join(a, b)
    labels = np.empty(n, np.int64)
    labels[order] = order[forest.labels()]
    return labels


def candidate_members(groups: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows (grp, sub, node) of (grp, sub, part, node, size, bits, comp) that have a possible partner in their group.

    Where both parts 0 and 1 occur in a sub-group, pairs within a part are found in another one.
    """

    def run(key, table):
        size, part = table.column("size").to_numpy(), table.column("part").to_numpy()
        node, comp = table.column("node").to_numpy(), table.column("comp").to_numpy()
        bits = [np.frombuffer(x, np.uint64) for x in table.column("bits").to_pylist()]
        order = np.lexsort(([int(b[0]) for b in bits], size))
        size, part, node, comp, bits = size[order], part[order], node[order], comp[order], [bits[i] for i in order]
        i, j = possible_pairs(bits, size, np.unique(comp, return_inverse=True)[1], percent)
        ok = (part[i] != part[j]) | (part.min() == part.max())
        found = np.unique(np.concatenate([node[i[ok]], node[j[ok]]]))
        return pa.table([pa.array(np.full(len(found), k.as_py()), t) for k, t in zip(key, (pa.int64(), pa.int32()))] + [pa.array(found)], names=["grp", "sub", "node"])

    return groups.groupBy("grp", "sub").applyInArrow(run, "grp bigint, sub int, node bigint")


def join_groups(groups: DataFrame, reps: DataFrame, docs: DataFrame, percent: int = PERCENT, n: int = N) -> DataFrame:
    """Edges (a, b) within groups of (grp, sub, node) rows; texts are fetched by the nodes' documents."""
    # groups of one node have nothing to compare; ids are joined first, so texts move to their document and to their group only
    full = groups.groupBy("grp", "sub").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("grp", "sub")
    named = groups.join(full, ["grp", "sub"]).join(reps.select("node", "doc_id", "h2"), "node")
    rows = named.join(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "doc_id").select("grp", "sub", "node", "h2", "text")

    def run(table: pa.Table) -> pa.Table:
        nodes, sets, seen = [], [], set()
        found = [s for b in row_slices(table.to_batches(), "text", SLICE_BYTES) for s in shingle_sets(b.column("text").to_pylist(), n)]
        for node, h2, s in zip(table.column("node").to_pylist(), table.column("h2").to_pylist(), found):
            if node not in seen and len(s) and _set_hash(s) == (node, h2):  # an id may stand for several texts
                seen.add(node)
                nodes.append(node)
                sets.append(s)
        if len(sets) < 2:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        labels = join_group(sets, percent)
        nodes = np.array(nodes, np.int64)
        at = np.flatnonzero(labels != np.arange(len(labels)))
        if table.nbytes > LARGE_GROUP:
            del table, found, sets
            release()
        return pa.table({"a": nodes[at], "b": nodes[labels[at]]})

    return rows.groupBy("grp", "sub").applyInArrow(run, "a bigint, b bigint")


def jaccard_components(docs: DataFrame, percent: int = PERCENT, n: int = N, max_group: int = MAX_GROUP) -> DataFrame:
    """(doc_id, n_shingles, component_id) of all rows of ``docs`` (doc_id, text)."""
    made = stored(describe_sets(docs, n), "sets")
    base = made.where("block is null")
    classes = token_classes(made.where("block is not null"))
    whole = base.where("doc_id is not null and size > 0")
    reps = stored(whole.groupBy(F.col("h1").alias("node"), "h2").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("bits").alias("bits")), "reps")
    tokens = prefix_tokens(docs.where("doc_id is not null"), classes, percent, n)
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    held = stored(tokens.join(shared.select("token", "n", "lo"), "token").distinct(), "prefixes")

    # first step: a node's most popular token, equal popularity by token
    popular = held.groupBy("node").agg(F.max(F.struct("n", "token", "lo")).alias("p")).select("node", "p.*")
    popular = popular.withColumn("parts", F.ceil(F.col("n") / max_group).cast("int"))
    first = popular.select("node", F.col("token").alias("grp"), "lo", "parts",
                           F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("sub"))
    first = stored(first, "first-groups")
    leaders = first.where("parts > 1").groupBy("grp", "sub").agg(F.min("lo").alias("node")).select("grp", "sub", "node")
    edges = stored(join_groups(first.select("grp", "sub", "node").union(leaders).distinct(), reps, docs, percent, n), "edges")
    comp = connected_components(edges)

    # second step: tokens whose nodes have not all met
    met = F.when(F.col("parts") == 1, F.col("grp"))
    known = first.select("node", met.alias("met")).join(comp, "node", "left").select("node", "met", F.coalesce("comp", "node").alias("comp"))
    rest = held.select("token", "node").join(known, "node")
    open_ = rest.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who"),
        F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.min("met").alias("m1"), F.max("met").alias("m2"), F.count("met").alias("mn"))
    open_ = open_.where("c1 <> c2 and not (mn = n and m1 = m2)")
    open_ = stored(open_.groupBy("n", "who").agg(F.min("token").alias("token")).select("token", "n"), "open-tokens")
    second = held.select("token", "node").join(open_, "token").withColumn("parts", F.ceil(F.col("n") / max_group).cast("int"))
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    # part p of P meets every part q: the pair (min, max) is sub-group min * P + max
    second = second.withColumn("p", mine).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    second = second.select(F.col("token").alias("grp"), (F.least("p", "q") * F.col("parts") + F.greatest("p", "q")).alias("sub"),
                           F.when(F.col("p") > F.col("q"), 1).otherwise(0).alias("part"), "node")
    second = second.join(reps.select("node", "size", "bits"), "node").join(known.select("node", "comp"), "node")
    # texts move for the members that the trees leave, to be decided in the group
    near = stored(candidate_members(second, percent), "members")
    more = stored(join_groups(near, reps, docs, percent, n), "edges")
    comp = connected_components(edges.union(more))

    of_set = reps.select("node", "h2", "doc_id").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    smallest = of_set.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = of_set.select("node", "h2", "comp").join(smallest, "comp").select(F.col("node").alias("h1"), "h2", "component_id")
    out = base.join(named, ["h1", "h2"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("size").alias("n_shingles"), own.alias("component_id"))
