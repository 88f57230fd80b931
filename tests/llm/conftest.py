import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))]
    # names the operators give to their own columns
    + [T.StructField(n, T.StringType()) for n in ("kept", "score", "copy", "fp", "digest", "ids")]
)


@pytest.fixture(scope="session")
def make(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, source) with extra columns of clashing names."""

    def of(rows):
        full = [(i, t, None, s[0] if s else None, None if t is None else len(t), "a", "b", "c", "d", "e", "f") for i, t, *s in rows]
        return spark.createDataFrame(full, DOCS)

    return of


LONG = "word " * 40_000 + "x" * 50_000
ODD = [(1, None), (2, ""), (3, "a b  c"), (3, "a b  c"), (4, "a b c"), (None, "a\tb c"), (5, LONG), (6, LONG), (7, " \n")]


@pytest.fixture(scope="session")
def odd(make):
    return make(ODD)


@pytest.fixture(scope="session")
def empty(make):
    return make([])
