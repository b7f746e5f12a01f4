"""Operator 4: SentencePiece encoding and decoding by an Aho-Corasick automaton and a single-pass Viterbi.

The automaton holds all ordinary pieces of a vocabulary.  It is run over a word once; at each position it follows its output
links, which give every piece that ends there, and each of them relaxes the best score of that position.  A character that no
one-character piece covers may be taken as unknown at the lowest score less ``UNKNOWN_PENALTY`` and is spelled in byte pieces.
Of equal scores the longest last piece wins.  Scores are added in double precision.

No piece holds a word mark after another character, so no piece crosses the start of a run of marks: a text falls apart into
words (marks, then other characters) whose best segmentations are independent.  Each task keeps the segmentations of the words
it met in a table of bounded size, so the cost is one automaton run per distinct word and one look-up per word.  Vocabularies
with pieces that break that property are refused.

A null text has null ids and a null decoded text; an empty text has no ids.  Texts of any length are encoded whole; one word is
one automaton run, so memory grows with the longest text.  A text that holds the word mark U+2581 decodes with blanks in its
place, as in the public library; every other text decodes to itself.  Repeated rows give repeated results; all other columns
pass through unchanged.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import extended, map_arrow, row_slices

MARK = "▁"
UNKNOWN_PENALTY = 10.0
MODEL = os.environ.get("TIDEWAKE_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
WORDS_KEPT = 160_000  #: words in a task's table; a full table is begun anew
_NEVER = -float("inf")
LONG_WORD = 64  #: longer words are not kept
SLICE_BYTES = 1 << 20
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Pieces:
    """A vocabulary: ``pieces`` (text, score) by id, byte pieces by byte, and the automaton."""

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: list[int], ordinary: list[bool], unknown: int = 0):
        self.byte_ids, self.unknown = byte_ids, unknown
        self.raw = [p.replace(MARK, " ").encode() for p, _ in pieces]
        for b, i in enumerate(byte_ids):
            self.raw[i] = bytes([b])
        self.automaton = ahocorasick.Automaton()
        self.single = set()
        lowest = 0.0
        for i, (p, score) in enumerate(pieces):
            if ordinary[i]:
                if MARK in p.lstrip(MARK):
                    raise ValueError(f"piece {p!r} crosses the start of a word")
                self.automaton.add_word(p, (len(p), score, i))
                lowest = min(lowest, score)
                if len(p) == 1:
                    self.single.add(p)
        self.automaton.make_automaton()
        self.unknown_score = lowest - UNKNOWN_PENALTY
        self.table: dict[str, tuple[list[int], float]] = {}

    @classmethod
    def from_model(cls, path: str) -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = len(m)
        own = [not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)) for i in range(n)]
        names = [(m.id_to_piece(i), m.get_score(i)) for i in range(n)]
        byte_ids = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        return cls(names, byte_ids if m.is_byte(byte_ids[0]) else [], own, m.unk_id())

    def best(self, word: str) -> tuple[list[int], float]:
        """Ids and score of the best segmentation of a text in one pass over it."""
        n = len(word)
        score = [0.0] + [_NEVER] * n
        start, piece = [0] * (n + 1), [-1] * (n + 1)
        if self.single.issuperset(word):
            # the longest piece that ends at a position comes first, so it wins ties
            for last, (length, gain, i) in self.automaton.iter(word):
                e = last + 1
                if (s := score[e - length] + gain) > score[e]:
                    score[e], start[e], piece[e] = s, e - length, i
        else:
            ends: list[list] = [[] for _ in range(n)]
            for last, found in self.automaton.iter(word):
                ends[last].append(found)
            for e in range(1, n + 1):
                for length, gain, i in ends[e - 1]:
                    if (s := score[e - length] + gain) > score[e]:
                        score[e], start[e], piece[e] = s, e - length, i
                if word[e - 1] not in self.single and (s := score[e - 1] + self.unknown_score) > score[e]:
                    score[e], start[e], piece[e] = s, e - 1, -1
        ids: list[int] = []
        e = n
        while e:
            b, i = start[e], piece[e]
            if i >= 0:
                ids.append(i)
            elif self.byte_ids:
                ids.extend(self.byte_ids[x] for x in reversed(word[b:e].encode()))
            else:
                ids.append(self.unknown)
            e = b
        return ids[::-1], score[n]

    def encode(self, text: str) -> tuple[list[int], float]:
        if not text:
            return [], 0.0
        table, ids, total = self.table, [], 0.0
        for w in _WORD.findall(MARK + text.replace(" ", MARK)):
            got = table.get(w)
            if got is None:
                got = self.best(w)
                if len(w) <= LONG_WORD:
                    if len(table) >= WORDS_KEPT:
                        table.clear()
                    table[w] = got
            ids += got[0]
            total += got[1]
        return ids, total

    def decode(self, ids: list[int]) -> str:
        """Byte pieces that are no UTF-8 give U+FFFD; the first blank is the one that encoding put there."""
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")[1:]


@lru_cache(maxsize=2)
def load_pieces(path: str) -> Pieces:
    """The vocabulary of a file, once per Python worker."""
    return Pieces.from_model(path)


def encode_pieces(docs: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """``docs`` with ids (array of int) and score (the segmentation's, summed)."""
    keep = [c for c in docs.columns if c not in ("ids", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load_pieces(model)
        for b in row_slices(batches, text, SLICE_BYTES):
            got = [None if t is None else pieces.encode(t) for t in b.column(text).to_pylist()]
            ends = np.cumsum([0] + [0 if g is None else len(g[0]) for g in got]).astype(np.int32)
            flat = np.fromiter(chain.from_iterable(g[0] for g in got if g), np.int32, int(ends[-1]))
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array([g is None for g in got]))
            scores = pa.array([None if g is None else g[1] for g in got], pa.float64())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], ids, scores], names=[*keep, "ids", "score"])
        pieces.table.clear()  # the worker lives on, and with it the vocabulary; the words are the task's

    return map_arrow(docs, run, extended(docs.schema, ids="array<int>", score="double"))


def decode_pieces(encoded: DataFrame, ids: str = "ids", out: str = "decoded", model: str = MODEL) -> DataFrame:
    """``encoded`` with the text that its ids spell."""
    keep = [c for c in encoded.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load_pieces(model)
        for b in row_slices(batches, ids, 1 << 18):
            col = b.column(ids)
            flat = col.flatten().to_numpy()
            ends = np.cumsum(pc.fill_null(col.value_lengths(), 0).to_numpy(zero_copy_only=False)).tolist()
            texts = [pieces.decode(flat[a:e].tolist()) if ok else None for a, e, ok in zip([0, *ends], ends, col.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(texts, pa.string())], names=[*keep, out])

    return map_arrow(encoded, run, extended(encoded.schema, **{out: "string"}))
