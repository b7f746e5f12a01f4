"""Words of whole texts as 64-bit fingerprints, and a bit table of bounded size for "may be one of these".

Words are the maximal runs of digits, ASCII letters and characters beyond ASCII, with A-Z in lower case.  A batch of texts is
hashed at once from its UTF-8 bytes; equal words have equal fingerprints in every task.  Nulls and empty texts have no words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import mix64

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  #: a word, before A-Z are lower-cased
SLICE_BYTES = 1 << 20
MIN_BITS, MAX_BITS = 16, 26  #: a table has 2^16 to 2^26 cells: 8 MB at most
_BASE = 0x9E3779B97F4A7C15
_KEEP = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_FOLD = np.arange(256)
_FOLD[ord("A") : ord("Z") + 1] += 32
_BYTE = np.random.default_rng(11).integers(0, 1 << 64, 256, dtype=np.uint64)[_FOLD]


def powers(n: int) -> np.ndarray:
    """1, b, b^2, ... modulo 2^64."""
    out = np.full(max(n, 1), _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_SHORT = powers(256)


def word_prints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints of all words in order, their number up to each text: one more than texts)."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    keep = _KEEP[data]
    before = np.zeros(len(data), bool)
    before[1:] = keep[:-1]
    before[edges[:-1][edges[:-1] < len(data)]] = False  # words end with their text
    start = np.flatnonzero(keep & ~before)
    upto = np.searchsorted(start, edges)
    if not len(start):
        return np.zeros(0, np.uint64), upto
    letters = data[keep]
    head = np.concatenate([[0], np.cumsum(keep)[start[1:] - 1]])
    size = np.diff(np.append(head, len(letters)))
    place = np.arange(len(letters)) - np.repeat(head, size)
    table = _SHORT if size.max() <= len(_SHORT) else powers(int(size.max()))
    return mix64(np.add.reduceat(_BYTE[letters] * table[place], head) + size.astype(np.uint64)), upto


def shingle_prints(words: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of all runs of ``n`` words (those that cross texts included)."""
    m = max(0, len(words) - n + 1)
    out, power = np.full(m, n, np.uint64), powers(n + 1)
    for i in range(n):
        out += words[i : m + i] * power[i + 1]
    return mix64(out)


def bit_table(prints: DataFrame, column: str, size: int) -> tuple[np.ndarray, int]:
    """(packed bits, log2 of their number) of the fingerprints in ``column``: about 512 cells for each of ``size`` of them, and
    never more than 2^MAX_BITS.  Built by a bitmap aggregate; the driver gets at most 2,048 rows of 4 KB."""
    bits = min(MAX_BITS, max(MIN_BITS, int(512 * size).bit_length()))
    h = F.col(column)
    cells = prints.select(F.explode(F.array(F.shiftrightunsigned(h, 64 - bits), F.shiftrightunsigned(F.shiftleft(h, MAX_BITS), 64 - bits))).alias("cell"))
    parts = cells.groupBy(F.shiftright("cell", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("cell") % 32768).alias("bits"))
    table = np.zeros(1 << bits - 3, np.uint8)
    for r in parts.collect():
        table[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return table, bits


def may_hold(table: np.ndarray, bits: int, prints: np.ndarray) -> np.ndarray:
    """Positions of the fingerprints that the table does not rule out."""
    def hit(p, left):
        cell = (p << np.uint64(left) if left else p) >> np.uint64(64 - bits)
        return (table[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 > 0

    at = np.flatnonzero(hit(prints, 0))
    return at[hit(prints[at], MAX_BITS)]


def lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    """A list column: row i holds values[ends[i] : ends[i + 1]]."""
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))
