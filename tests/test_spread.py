"""Heavy work on each row of a narrow table runs in all tasks, and once for all that need it."""

import os

import pytest

from changelens.queries import catalog

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ["x2_union", "x2_xpath_nodes"])
def test_documents_are_tested_once_for_all_expressions(spark, name):
    found = catalog.QUERIES[name](spark, SF_DIR)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_xml(") == 1
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("name", ["x5_nested_markup", "c2_deep_brackets", "c1_nested_declarations"])
def test_rows_are_dealt_out(spark, name):
    assert catalog.QUERIES[name](spark, SF_DIR).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_definitions_are_not_broadcast_by_an_estimate(spark):
    found = catalog.QUERIES["j5_resolve_refs"](spark, SF_DIR)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 3
