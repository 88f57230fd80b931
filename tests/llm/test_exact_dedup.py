import re
from collections import defaultdict

from pyspark.sql import functions as F

from changelens.llm import exact_dedup
from changelens.llm.common import new_folder

from .conftest import ODD

PYTHON = ("Python", "Pandas", "Arrow")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for ids in groups.values():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i or 0, keep, len(ids)) for i in ids]
    return sorted(out)


def found(df):
    return sorted((r["doc_id"] or 0, r["keep_id"], r["group_size"]) for r in df.collect())


def test_odd_rows(odd):
    df = exact_dedup.exact_duplicates(odd)
    assert found(df) == brute(ODD)
    kept = df.where("kept").groupBy("text_sha256").count().collect()
    assert all(r["count"] == 1 for r in kept) and len(kept) == df.select("text_sha256").distinct().count()


def test_equal_digests_of_different_texts(make, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LOT", 2)
    rows = [(i, "abc"[i % 3] * (1 + i % 2)) for i in range(40)] + [(50, None)]
    df = exact_dedup.exact_duplicates(make(rows), digest=lambda text: F.octet_length(text).cast("string"))
    assert found(df) == brute(rows)
    assert df.where("kept").count() == 7


def test_empty_table(empty):
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert exact_dedup.without_duplicates(empty).columns == empty.columns


def test_kept_rows_have_all_columns(odd):
    out = exact_dedup.without_duplicates(odd)
    assert out.columns == odd.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3, 5, 7]


def test_state_goes_on(spark, make):
    schema = "digest string, row struct<no_id:boolean,id:bigint,at:bigint,locator:string,size:bigint>"
    arrivals, checkpoint = new_folder(spark, "t"), new_folder(spark, "t")

    def arrive(ids):
        rows = spark.createDataFrame([(i,) for i in ids], "i bigint")
        rows.selectExpr("'d' AS digest", "named_struct('no_id', false, 'id', i, 'at', i, 'locator', '', 'size', 1L) AS row").write.mode(
            "append"
        ).parquet(arrivals)
        return exact_dedup.streamed_state(arrivals, schema, checkpoint).select("first.id", "n_rows").collect()

    assert [tuple(r) for r in arrive([7, 9])] == [(7, 2)]
    assert [tuple(r) for r in arrive([3])] == [(3, 3)]
    assert [tuple(r) for r in arrive([8])] == [(3, 4)]


def test_no_python_on_the_way(odd):
    plan = exact_dedup.exact_duplicates(odd)._jdf.queryExecution().toString()
    assert not any(p in plan for p in PYTHON)
