"""The registered queries: names, SQL, and the tables they are checked on."""

import re

import pytest

import __spark_entry__ as entry
from changelens.llm import queries

from ..compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"


def test_all_operators_and_the_pipeline_are_registered():
    names = set(entry.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.SQL) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= names


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SF_DIR), connect(SF_DIR), queries.SQL[name]) is None


@pytest.mark.parametrize("name", ["op3_quality_rules", "op7_exact_dedup", "op8_mixing"])
def test_native_queries_have_no_python(spark, name):
    plan = queries.QUERIES[name](spark, SF_DIR)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
