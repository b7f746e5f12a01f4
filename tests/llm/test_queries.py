"""The queries of this subpackage as they are registered, and the pipeline."""

import subprocess
import sys

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tidewake.llm.common import stored

SF = "/root/testdata/sf0.001"
NUMBERS = range(1, 14)


def test_all_are_registered():
    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in NUMBERS) and "pipeline" in names


@pytest.mark.parametrize("name", [n for n in entry.queries() if n.startswith("op") and n not in entry.oracle_sql()])
def test_one_row_per_document(spark, name):
    df = entry.queries()[name](spark, SF)
    assert df.select("doc_id").distinct().count() == spark.read.parquet(f"{SF}/documents.parquet").count() == df.count()


def test_pipeline_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stored(stage(spark, docs, SF), "pipeline-test")
        assert docs.count() > 0
        if i < 4:
            assert sorted(docs.columns) == sorted(corpus_pipeline.COLUMNS)
        if i < 3:
            assert docs.count() == docs.select("doc_id").distinct().count() <= before.count()
    assert docs.where("not round_trip").isEmpty()
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_pipeline_edges(spark, documents):
    junk = documents([(1, None), (2, "?!? 12"), (3, "the house is old and the wind is cold", "en"), (3, "the house is old and the wind is cold", "en"),
                      (None, "the house is old and the wind is cold today", None)])
    for rows, want in ((junk, 2), (documents([]), 0)):
        docs = rows
        for _, stage in corpus_pipeline.STAGES[:3]:
            docs = stored(stage(spark, docs, SF), "pipeline-test")
        assert docs.count() == want
        for _, stage in corpus_pipeline.STAGES[3:]:
            docs = stored(stage(spark, docs, SF), "pipeline-test")


def test_rest_works_without_this_subpackage(tmp_path):
    """The entry module imports and lists the other queries where llm and the pipeline are gone."""
    code = ("import sys\nclass Gone:\n def find_spec(self, name, *a):\n  if name.startswith(('tidewake.llm', 'corpus_pipeline')):\n"
            "   raise ModuleNotFoundError(name=name)\nsys.meta_path.insert(0, Gone())\nimport __spark_entry__ as e\n"
            "assert len(e.queries()) > 300 and not any(n.startswith('op1_') or n == 'pipeline' for n in e.queries())")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rsplit("/", 1)[0], timeout=120)
