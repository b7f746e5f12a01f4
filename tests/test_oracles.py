"""Every query with an oracle gives the same rows as its SQL; the others give rows."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
# iterative fits run once in the benchmark check, not in every test run
SLOW = {"T12_fit_logistic", "T18_fit_linear_svm", "T30_fit_calibrator", "T32_grid_search", "T33_permutation_importance",
        "N19_select_k", "T31_oof_stack", "T29_isotonic_calibration", "T15_fit_gbt", "T19_kmeans_sweep"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def cell(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        v = int(v)
    if isinstance(v, (int, float)):
        return (1, float(v)) if not (isinstance(v, float) and math.isnan(v)) else (2, "nan")
    if isinstance(v, (list, tuple)):
        return (3, str([cell(x) for x in v]))
    return (4, v.isoformat().replace("+00:00", "") if hasattr(v, "isoformat") else str(v))


def key(row):
    return tuple((k, round(v, 2) if k == 1 else v) for k, v in row)


def close(a, b):
    if a[0] == b[0] == 1:
        return math.isclose(a[1], b[1], rel_tol=1e-6, abs_tol=2e-5)
    return a == b


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE])
def test_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(ORACLE[name])
    assert sorted(rel.columns) == cols
    pos = [list(rel.columns).index(c) for c in cols]
    want = sorted((tuple(cell(r[i]) for i in pos) for r in rel.fetchall()), key=key)
    got = sorted((tuple(cell(r[c]) for c in cols) for r in df.collect()), key=key)
    assert len(got) == len(want)
    bad = [(g, w) for g, w in zip(got, want) if not all(map(close, g, w))]
    assert not bad, bad[:3]


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE and n not in SLOW])
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).limit(1).count() == 1


def test_entry(spark):
    assert entry.entry(spark).count() == 5
