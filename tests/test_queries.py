"""Every registered query against its SQL on the given tables."""

import os

import pytest

import __spark_entry__ as entry
from changelens.queries import catalog

from .compare import connect, difference

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = catalog.QUERIES, catalog.SQL


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF_DIR), con, SQL[name]) is None


def test_every_query_has_sql_and_is_registered():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
