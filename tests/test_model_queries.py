"""Queries whose target is not a label use all documents."""

import pytest
from pyspark.sql import functions as F

from tidewake.operators import models
from tidewake.plans import load_all
from tidewake.plans.model_queries import FEATS, doc_features, labelled_features
from tidewake.plans.registry import Tables

SF = "/root/testdata/sf0.001"


def test_features_of_all_documents(spark):
    t = Tables(spark, SF)
    d = doc_features(t)
    assert d.count() == t.documents.count() and {r["fold"] for r in d.select("fold").distinct().collect()} == {0, 1, 2}
    assert d.where(" or ".join(f"{c} is null" for c in FEATS)).count() == 0
    assert labelled_features(t).count() == t.documents.join(t.labels, "doc_id").count()


@pytest.mark.parametrize("name", ["T12b_multinomial", "T14c_forest_regression"])
def test_unlabelled_documents_are_predicted(spark, name):
    t = Tables(spark, SF)
    got = load_all()[0][name](spark, SF)
    assert got.join(t.labels, "doc_id", "left_anti").count() > 0
    want = doc_features(t).where("fold = 0").where(F.col("lang").isin("de", "en", "es", "fr") | F.lit(name != "T12b_multinomial"))
    assert got.count() == want.count()


def test_importance_of_the_column_that_decides(spark):
    rows = [(i, float(i % 10), float(i * 7 % 13), int(i % 10 > 4)) for i in range(400)]
    d = spark.createDataFrame(rows, "id bigint, a double, b double, y int")
    got = models.permutation_importance(models.fit_logistic(d, ["a", "b"], "y", 0.01), d, ["a", "b"], "y", "id", 2).collect()
    drop = {r["column"]: r["importance"] for r in got}
    assert len(drop) == 2 and drop["a"] > 0.3 and abs(drop["b"]) < 0.05 and all(r["std"] is not None for r in got)
