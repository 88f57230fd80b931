"""JSON documents that repeat a key in one object."""

import pytest
from pyspark.sql import functions as F

from changelens.functions.jsonx import json_extract, json_path, keep_last, last_values
from changelens.operators.jsondiff import json_entry_diff, json_nodes
from changelens.operators.snapshots import snapshot_diff
from changelens.plans.reports import Rule, run_rules


@pytest.mark.parametrize("text,want", [
    ('{"a":1,"a":2}', '{"a":2}'),
    ('{"a":1, "b":[{"x":1.50,"x":1e5}], "a":{"é":null,"é":"\\u00e9\\n"}}', '{"a":{"é":"é\\n"},"b":[{"x":1e5}]}'),
    ("[1,", "[1,"),
    ('{"a":12345678901234567890123,"a":0.10}', '{"a":0.10}'),
])
def test_keep_last(text, want):
    assert keep_last(text) == want


def test_one_such_document_does_not_stop_the_others(spark):
    df = spark.createDataFrame([(1, '{"a":1,"a":2}'), (2, '{"a":3}'), (3, None), (4, "{}")], "id int, doc string")
    rows = {r["id"]: (r["v"], r["t"]) for r in df.select("*", last_values(F.col("doc")).alias("one")).select("id", json_path(F.col("one"), "$.a").alias("v"), json_extract(F.col("doc"), ".a", repeated_keys="last")["text"].alias("t")).collect()}
    assert {i: v for i, (v, _) in rows.items()} == {1: "2", 2: "3", 3: None, 4: "null"}
    assert rows[1][1] == "2\n" and rows[2][1] == "3\n"


def test_invalid_documents_still_stop_a_strict_run(spark):
    df = spark.createDataFrame([('{"a":1,"a":',)], "doc string")
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        df.select(last_values(F.col("doc")).alias("doc")).select(json_path(F.col("doc"), "$.a")).collect()
    assert df.select(last_values(F.col("doc")).alias("doc")).select(json_path(F.col("doc"), "$.a", strict=False)).first()[0] is None


def test_nodes_and_entry_differences(spark):
    df = spark.createDataFrame([(1, '{"a":1,"a":2,"b":0}', '{"b":0,"a":3,"a":4}')], "id int, old string, new string")
    df = df.select("id", last_values(F.col("old")).alias("old"), last_values(F.col("new")).alias("new"))
    assert [tuple(r) for r in json_entry_diff(df, ["id"], "old", "new").collect()] == [(1, "a", "changed", "2", "4")]
    assert {(r["path"], r["value"]) for r in json_nodes(df, ["id"], "old").collect()} >= {("$.a", "2"), ("$.b", "0")}


def test_rules_over_such_documents(spark):
    base = spark.createDataFrame([("x.json", '{"v":1,"v":2}'), ("y.json", '{"v":1}')], "path string, content string")
    head = spark.createDataFrame([("x.json", '{"v":9,"v":3}'), ("y.json", '{"v":5}')], "path string, content string")
    changes = snapshot_diff(base, head, ["path"], "content").selectExpr("path", "path AS old_path", "path AS new_path", "type")
    stored = base.select(F.lit("b").alias("ref"), "path", "content").union(head.select(F.lit("h").alias("ref"), "path", "content"))
    rules = [Rule("c", 0, i, ("*.json",), "jq", {"query": q, "repeated_keys": "last"}) for i, q in enumerate((".v", ". | keys"))]
    found = run_rules(changes, stored, rules, ["path"], "b", "h").collect()
    assert sorted((r["path"], r["left_artifact"], r["right_artifact"]) for r in found) == [("x.json", "2\n", "3\n"), ("y.json", "1\n", "5\n")]
