"""N-gram counts by blocks of token lists.

A block numbers its own words, counts its n-grams as integers and deals them, by a hash of their words, over ``parts`` groups: a
group gets one row per block, with the words it needs once and the n-grams as numbers.  A group counts what its blocks found.
Memory is bounded by a block and by a group, and an n-gram costs a few bytes of shuffle however long its words are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BLOCK = 2_000_000
PARTS = 512


def _fold(cols: list[np.ndarray], base: int) -> np.ndarray:
    """One integer per row, equal for equal rows only."""
    key, size = cols[0].astype(np.int64), base
    for c in cols[1:]:
        if size * base >= 1 << 62:
            seen, key = np.unique(key, return_inverse=True)
            size = len(seen)
        key, size = key * base + c, size * base
    return key


def _counted(cols: list[np.ndarray], base: int, n: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of ``cols`` and how often they occur, or the sums of ``n``."""
    key = _fold(cols, base)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    total = np.diff(np.r_[first, len(key)]) if n is None else np.add.reduceat(n[order], first) if len(key) else n
    return [c[order[first]] for c in cols], total


def _coded(words) -> tuple[np.ndarray, pa.Array]:
    """Numbers of ``words`` and the distinct words; a null word is one as well."""
    d = words.dictionary_encode(null_encoding="encode")
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary


def _windows(lists: pa.Array, n: int, padded: bool) -> tuple[list[np.ndarray], list[str | None]]:
    """All n-grams of ``lists`` as ``n`` columns of word numbers, and the words."""
    lists = lists.drop_null()
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    codes, seen = _coded(lists.flatten())
    words = seen.to_pylist()
    lead, tail = (max(n, 2) - 1, 1) if padded else (0, 0)
    full = sizes + lead + tail
    ends = np.cumsum(full)
    at = np.full(int(full.sum()), len(words), np.int32)
    if tail:
        at[ends - 1] = len(words) + 1
    inside = np.repeat(ends - full + lead - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(codes))
    at[inside] = codes
    left = np.repeat(ends, full) - np.arange(len(at))
    start = np.flatnonzero(left >= n)
    # a mark that is a word as well has one number
    extra = ["<s>", "</s>"] if padded else []
    known = {w: i for i, w in enumerate(words)}
    same = np.array([*range(len(words)), *[known.get(w, len(words) + i) for i, w in enumerate(extra)]], np.int32)
    return [same[at[start + i]] for i in range(n)], [*words, *extra]


def _blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK) -> Iterator[pa.Array]:
    """Token lists in runs of about ``size`` tokens; no list is cut."""
    held, tokens = [], 0
    for b in batches:
        col = b.column(0)
        while len(col):
            ends = col.offsets.to_numpy()[1:] - col.offsets.to_numpy()[0]
            take = max(1, int(np.searchsorted(ends, size - tokens, "right")))
            held.append(col.slice(0, take))
            tokens += int(ends[take - 1])
            col = col.slice(take)
            if tokens >= size or len(col):
                yield pa.concat_arrays(held)
                held, tokens = [], 0
    if held:
        yield pa.concat_arrays(held)


_TOKEN, _BLANK, _STOP = (np.isin(np.arange(256), list(x)) for x in (b"abcdefghijklmnopqrstuvwxyz_", b" \t\n\x0b\f\r", b".!?"))


def sentence_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token lists of the sentences with a token, as ``textops.sentence_tokens`` gives them, read from the bytes of whole texts."""
    for batch in batches:
        text = "\n".join(x for x in batch.column(0).to_pylist() if x).lower() + "\n"
        b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        inside = _TOKEN[b]
        edges = np.flatnonzero(np.diff(np.r_[False, inside, False]))
        start, size = edges[::2], edges[1::2] - edges[::2]
        inside[start[size < 2]] = False  # a token has two letters
        start, size = start[size >= 2], size[size >= 2]
        # a sentence ends at a line break, and at a stop before a blank
        ended = np.cumsum((b == 10) | (_STOP[b] & np.r_[_BLANK[b[1:]], False]))[start]
        first = np.flatnonzero(np.r_[True, ended[1:] != ended[:-1]]) if len(start) else np.zeros(0, np.int64)
        ends = np.r_[0, np.cumsum(size)].astype(np.int32)
        words = pa.StringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(b[inside]))
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.r_[first, len(start)], pa.int32()), words)], names=["t"])


def _deal(n: int, padded: bool, parts: int, read=iter):
    def run(batches):
        for lists in _blocks(read(batches)):
            cols, words = _windows(lists, n, padded)
            cols, total = _counted(cols, max(1, len(words)))
            h = np.array([0 if w is None else zlib.crc32(w.encode("utf-8", "surrogatepass")) + 1 for w in words], np.uint64)
            mix = np.zeros(len(total), np.uint64)
            for c in cols:
                mix = (mix ^ h[c]) * np.uint64(0x9E3779B97F4A7C15)
                mix ^= mix >> np.uint64(29)
            part = (mix % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            grams, total, part = np.stack([c[order] for c in cols]), total[order].astype(np.uint32), part[order]
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
            own, rows, counts = [], [], []
            for a, z in zip(first, [*first[1:], len(part)]):
                used, local = np.unique(grams[:, a:z], return_inverse=True)
                own.append(used)
                rows.append(local.astype(_kind(len(used))).tobytes())
                counts.append(total[a:z].tobytes())
            ends = np.cumsum([0, *map(len, own)])
            own = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words, pa.string()).take(pa.array(np.concatenate([np.zeros(0, np.int64), *own]))))
            yield pa.RecordBatch.from_arrays([pa.array(part[first] if len(part) else [], pa.int32()), own,
                                              pa.array(rows, pa.binary()), pa.array(counts, pa.binary())], names=["_p", "words", "grams", "n"])

    return run


def _kind(words: int):
    """Numbers of so many words in as few bytes as hold them."""
    return np.uint8 if words <= 1 << 8 else np.uint16 if words <= 1 << 16 else np.uint32


def _gather(n: int):
    def run(t: pa.Table) -> pa.Table:
        lists, cols, total = t["words"].combine_chunks(), [], []
        codes, words = _coded(lists.flatten())
        ends = lists.offsets.to_numpy() - lists.offsets.to_numpy()[0]
        for a, z, g, c in zip(ends, ends[1:], t["grams"], t["n"]):
            local = np.frombuffer(g.as_buffer(), _kind(int(z - a))).reshape(n, -1)
            cols.append(codes[a:z][local])
            total.append(np.frombuffer(c.as_buffer(), np.uint32).astype(np.int64))
        cols, total = _counted(list(np.concatenate(cols, axis=1)), max(1, len(words)), np.concatenate(total))
        return pa.table([*[words.take(pa.array(c)) for c in cols], pa.array(total)], names=[*[f"w{i + 1}" for i in range(n)], "n"])

    return run


def count_grams(df: DataFrame, tokens: Column, n: int, padded: bool = True, parts: int = PARTS, read=iter) -> DataFrame:
    """(w1..wn, n) over the token lists of ``df``, or over those that ``read`` makes of the column's batches."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    dealt = df.select(tokens.alias("t")).mapInArrow(_deal(n, padded, parts, read), "_p int, words array<string>, grams binary, n binary")
    schema = ", ".join(f"w{i + 1} string" for i in range(n)) + ", n bigint"
    return dealt.repartition(max(1, parts // 4), "_p").groupBy("_p").applyInArrow(_gather(n), schema)
