import hashlib
import random

import pytest

from tidewake.llm import suffix_dedup


def brute(rows):
    """(n_bytes, n_removed, n_spans, sha256) by id; rows have distinct ids, null last."""
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - 99):
            s = raw[p : p + 100]
            if s in seen:
                gone[p : p + 100] = [True] * 100
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["removed"]), r["kept_sha256"]) for r in df.collect()}


def text(rnd, n, letters="abcdefgh é"):
    return "".join(rnd.choice(letters) for _ in range(n))


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(documents, seed):
    rnd = random.Random(seed)
    shared = [text(rnd, n) for n in (99, 100, 101, 130, 180, 400, 900)]
    rows = []
    for d in range(60):
        parts = [text(rnd, rnd.randint(0, 200))]
        for _ in range(rnd.randint(0, 4)):
            s = rnd.choice(shared)
            a = rnd.randint(0, 20) if rnd.random() < 0.5 else 0
            parts += [s[a:], text(rnd, rnd.randint(0, 60))]
        if rnd.random() < 0.2:
            parts += parts  # repeats inside a document
        rows.append((d, "".join(parts)))
    rows += [(100, "z" * 350), (101, "ab" * 300), (102, "z" * 99), (103, None), (104, ""), (None, rows[3][1])]
    rnd.shuffle(rows)
    got = result(suffix_dedup.remove_repeats(documents(rows, extra=True)))
    assert got == brute(rows)


def test_small_batches_agree(spark, documents, monkeypatch):
    rnd = random.Random(5)
    s = text(rnd, 300)
    rows = [(d, text(rnd, 50) + s[d % 7 :] + text(rnd, 80)) for d in range(80)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert result(suffix_dedup.remove_repeats(documents(rows))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_repeated_rows_keep_alike_and_cut_characters(documents):
    t = "é" * 60
    got = suffix_dedup.remove_repeats(documents([(1, t), (1, t), (2, "x" + t)])).collect()
    by = {(r["doc_id"], r["n_removed"], r["kept_text"]) for r in got}
    want = brute([(1, t), (2, "x" + t)])
    assert {(d, n) for d, n, _ in by} == {(1, want[1][1]), (2, want[2][1])} and len(got) == 3
    assert suffix_dedup.remove_repeats(documents([])).count() == 0


def by_text(df):
    return {(r["doc_id"], r["text"]): (r["n_bytes"], r["n_removed"], len(r["removed"]), r["kept_sha256"]) for r in df.collect()}


def test_texts_that_share_an_id_lose_only_their_own_repeats(documents):
    """Null ids, shared ids and the largest id: a repeat in one text cuts nothing from another."""
    rnd, ascii = random.Random(9), "abcdefghij"
    s = text(rnd, 250, ascii)
    alone = [text(rnd, n, ascii) for n in (700, 650, 600, 550)]
    for d in (None, 7, (1 << 63) - 1):
        rows = [(1, s), (d, text(rnd, 30, ascii) + s + text(rnd, 40, ascii)), *[(d, a) for a in alone], (d, alone[0])]
        got = by_text(suffix_dedup.remove_repeats(documents(rows)))
        want = brute(rows[:2])
        assert got[rows[1]] == want[d] and want[d][1] == 250
        assert all(got[d, a][1:3] == (0, 0) for a in alone), d


def test_null_comes_after_the_largest_id_and_one_text_of_a_shared_id_stays(documents):
    rnd = random.Random(10)
    s, last = text(rnd, 300, "abcdefghij"), (1 << 63) - 1
    got = by_text(suffix_dedup.remove_repeats(documents([(None, s), (last, s)])))
    assert got[last, s][1] == 0 and got[None, s][1] == 300
    for d in (None, 5):
        texts = [text(rnd, 40, "kl") + s + text(rnd, 20, "mn") for _ in range(8)]
        got = by_text(suffix_dedup.remove_repeats(documents([(d, t) for t in texts] * 2)))
        assert sorted(n and min(n, 300) for _, n, _, _ in got.values()) == [0] + [300] * 7  # neighbours may agree by chance


def test_columns_of_any_name_are_kept(documents):
    docs = documents([(1, "z" * 300), (2, "z" * 300)])
    wide = docs.selectExpr("*", "'a' as _doc", "'b' as _spans", "'c' as _h1", "'d' as runs").collect()
    got = suffix_dedup.remove_repeats(docs.selectExpr("*", "'a' as _doc", "'b' as _spans", "'c' as _h1", "'d' as runs")).collect()
    assert len(got) == len(wide) and all((r["_doc"], r["_spans"], r["_h1"], r["runs"]) == ("a", "b", "c", "d") for r in got)
