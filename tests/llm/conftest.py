import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table from (doc_id, text[, lang, source]) rows; further columns clash with names that operators add."""

    def make(rows, extra=False):
        full = [(r[0], r[1], *(list(r[2:]) + [None, None])[:2], None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            for c in ("score", "size", "ids", "kept", "component_id", "target", "copies", "node", "doc", "pos", "n", "licences", "_g"):
                df = df.selectExpr("*", f"'x' as {c}")
        return df

    return make
