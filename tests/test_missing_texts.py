"""Empty and missing texts are rows like any other; in ANSI mode a first element that is not there ends the whole job."""

import duckdb
import pytest

from changelens.queries import catalog

from .compare import difference

TABLES = {
    "documents": ("doc_id long, text string", [(1, 'a token = "abc" b'), (2, ""), (3, None), (4, "none"), (5, 'token = "x" and token = "y\\"')]),
    "customer": ("c_custkey long, c_name string", [(1, "Customer#7"), (2, ""), (3, None)]),
    "part": ("p_partkey long, p_name string, p_brand string, p_size int", [(5, "red blue", "B", 3), (6, None, None, None), (10, None, "B", None)]),
}


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("missing")
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["c2_template_extract", "e2_named_groups"])
def test_same_rows_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet/*.parquet')")
    assert difference(catalog.QUERIES[name](spark, sf_dir), con, catalog.SQL[name]) is None


@pytest.mark.parametrize(
    ("name", "key", "contexts"),
    [
        ("c2_template_extract", "doc_id", {1: '[{"VALUE":"abc"}]', 2: "[]", 3: None, 4: "[]", 5: '[{"VALUE":"x"},{"VALUE":"y\\\\"}]'}),
        ("c2_template_names", "c_custkey", {1: '[{"KIND":"Customer","NUM":"7"}]', 2: "[]", 3: None}),
        ("c1_declarations", "p_partkey", {5: '[{"name":"red5"},{"name":"blue"}]', 6: None, 10: None}),
        ("c2_deep_brackets", "p_partkey", {5: '[{"NAME":"a","VALUE":"b.c(5) + ((((x))))"}]', 6: None, 10: None}),
    ],
)
def test_context_is_the_list_of_one_side(spark, sf_dir, name, key, contexts):
    found = catalog.QUERIES[name](spark, sf_dir).select(key, "context")
    assert {row[0]: row[1] for row in found.collect()} == contexts
