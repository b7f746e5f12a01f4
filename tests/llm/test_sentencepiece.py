import random

import pytest
import sentencepiece as library

from tidewake.llm import sentencepiece as sp

TEXTS = ["Hello world ththe thndeaer", "the quick brown fox jumps over the lazy dog", "Éa au les queque", "a b", "tree inanstener enverschein"]


@pytest.fixture(scope="module")
def pieces():
    return sp.Pieces.from_model(sp.MODEL)


def brute(p, word):
    """All segmentations by dynamic programming over substrings; of equal scores the earliest start."""
    known = {k: v for k, v in p.automaton.items()}
    best = [(0.0, [])] + [None] * len(word)
    for e in range(1, len(word) + 1):
        for b in range(e):
            s = word[b:e]
            if s in known:
                c = (best[b][0] + known[s][1], best[b][1] + [known[s][2]])
            elif e - b == 1 and s not in p.single:
                c = (best[b][0] + p.unknown_score, best[b][1] + [p.byte_ids[x] for x in s.encode()])
            else:
                continue
            if best[e] is None or c[0] > best[e][0]:
                best[e] = c
    return best[-1]


def test_best_matches_brute_force(pieces):
    rnd = random.Random(1)
    for _ in range(500):
        w = sp.MARK + "".join(rnd.choice("abcthe ing\n\té梦😀") for _ in range(rnd.randint(0, 14))).replace(" ", sp.MARK)
        ids, score = pieces.best(w)
        assert (score, ids) == brute(pieces, w)


def test_words_are_independent(pieces):
    rnd = random.Random(2)
    for _ in range(200):
        t = "".join(rnd.choice("abct  he\n") for _ in range(rnd.randint(1, 40)))
        assert pieces.encode(t) == pieces.best(sp.MARK + t.replace(" ", sp.MARK))


def test_matches_public_library(pieces):
    """The library's unigram encoder over the same pieces and scores."""
    raw = open(sp.MODEL, "rb").read()
    at = raw.rindex(b"\x18\x02")  # trainer_spec.model_type: BPE
    unigram = library.SentencePieceProcessor()
    unigram.LoadFromSerializedProto(raw[:at] + b"\x18\x01" + raw[at + 2 :])
    same = 0
    for t in TEXTS:
        for w in t.split():
            ids, score = pieces.encode(w)
            theirs = unigram.encode(w)
            assert score >= sum(map(unigram.get_score, theirs))
            if len(theirs) > 1:  # it takes a word that is a piece as it is, whatever the score
                same += 1
                assert ids == theirs
    assert same > 5


def test_round_trip_and_edges(documents):
    rows = [(1, "Hello  world\n\n x"), (2, None), (3, ""), (4, " lead and trail "), (5, "😀 梦\u0000"), (6, "x" * 70_000), (6, "x" * 70_000)]
    df = sp.decode_pieces(sp.encode_pieces(documents(rows, extra=True)))
    got = [(r["doc_id"], r["text"], r["decoded"], r["ids"]) for r in df.collect()]
    assert len(got) == 7 and all(t == d for _, t, d, _ in got)
    assert {d: i for d, _, _, i in got}[2] is None and {d: i for d, _, _, i in got}[3] == []
    assert sp.encode_pieces(documents([])).count() == 0


def test_pieces_across_words_are_refused():
    with pytest.raises(ValueError):
        sp.Pieces([("a▁b", 1.0)], [], [True])
