from collections import defaultdict

import pytest

from tidewake.llm import mixing


def targets(sizes):
    """Water filling step by step over {source: size}."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    capped, left = set(), 1.5 * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        rest = left - sum(2 * sizes[s] for s in capped)
        out = {s: 2.0 * sizes[s] if s in capped else rest * w[s] / sum(w[x] for x in free) for s in names}
        over = [s for s in free if out[s] > 2 * sizes[s]]
        if not over:
            return out
        capped |= set(over)


def test_targets_and_takes(documents):
    rows = [(i, "w " * (1 + i * 7919 % 41), None, f"s{i % 5}" if i % 11 else None) for i in range(3000)]
    rows += [(5000 + i, "x " * 10, None, "tiny") for i in range(3)]
    got = mixing.mix_sources(documents(rows, extra=True)).collect()
    assert len(got) == len(rows)
    sizes, taken, goal = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        goal[r["source"]] = r["target"]
        assert 0 <= r["copies"] <= 2
    want = targets(dict(sizes))
    assert goal == pytest.approx(want)
    assert all(abs(taken[s] - goal[s]) <= 82 for s in goal)  # two of the largest documents
    again = mixing.mix_sources(documents(rows).repartition(7)).collect()
    assert {r["doc_id"]: r["copies"] for r in again} == {r["doc_id"]: r["copies"] for r in got}


def test_one_copy_per_boundary(spark):
    """Whole expected copies are met exactly; fractions are rounded up or down."""
    rows = [(i, "g", float(i % 4) / 2, 1) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, expected double, size int")
    got = mixing.systematic_copies(df, "source", "expected", "size", "doc_id").collect()
    assert all(r["copies"] == r["expected"] for r in got if r["expected"] in (0.0, 1.0))
    assert abs(sum(r["copies"] for r in got) - sum(r["expected"] for r in got)) <= 1


def test_edges(documents):
    got = mixing.mix_sources(documents([(1, None, None, "a"), (2, "", None, None), (3, "x y", None, "b"), (3, "x y", None, "b")])).collect()
    by = sorted((r["doc_id"], r["size"], r["source_size"], r["target"], r["copies"]) for r in got)
    assert [b[:4] for b in by] == [(1, 0, 0, 0.0), (2, 0, 0, 0.0), (3, 2, 4, 6.0), (3, 2, 4, 6.0)] and sum(b[4] for b in by) == 3
    assert mixing.mix_sources(documents([])).count() == 0


def test_columns_of_any_name_are_kept(documents):
    docs = documents([(i, "w " * (i % 7), None, f"s{i % 3}") for i in range(60)])
    plain = {r["doc_id"]: (r["copies"], r["target"]) for r in mixing.mix_sources(docs).collect()}
    names = ["_source", "_e", "_g", "_slice", "_start", "_end", "row", "key", "w", "level", "fits"]
    wide = mixing.mix_sources(docs.selectExpr("*", *[f"'{n}' as {n}" for n in names], "'x' as size", "'y' as copies"))
    rows = wide.collect()
    assert {r["doc_id"]: (r["copies"], r["target"]) for r in rows} == plain
    assert all(r[n] == n for r in rows for n in names)


def test_texts_are_shuffled_once_at_most(documents):
    plan = mixing.mix_sources(documents([(1, "a b", None, "s")]))._jdf.queryExecution().executedPlan().toString()
    assert sum("text" in line for line in plan.split("\n") if "Window" in line or "Aggregate" in line) == 0
