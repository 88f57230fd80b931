import math

from changelens.llm import mixing

from .conftest import ODD


def test_mean_is_the_rate(make):
    rows = [(i, "t", "big" if i % 4 else "small") for i in range(8_000)]
    out = mixing.mixed(make(rows), weights={"big": 1, "small": 3}, size=2).groupBy("__source").count().collect()
    counts = {r["__source"]: r["count"] for r in out}
    assert abs(counts["big"] - 4_000) < 5 * math.sqrt(4_000) and abs(counts["small"] - 12_000) < 5 * math.sqrt(12_000)


def test_draws_by_the_definition(make):
    rows = mixing.mixed(make([(i, "t", f"s{i % 7 * i % 3}") for i in range(500)]), size=3)
    drawn = {}
    for r in rows.select("doc_id", "__rate").collect():
        drawn[r["doc_id"]] = (r["__rate"], drawn.get(r["doc_id"], (0, 0))[1] + 1)
    import hashlib

    for i, (rate, n) in drawn.items():
        u = int(hashlib.md5(f"42:draw:{i}".encode()).hexdigest()[:13], 16) / 2**52
        k, term, below = 0, math.exp(-rate), math.exp(-rate)
        while below <= u:
            k += 1
            term *= rate / k
            below += term
        assert k == n


def test_large_mean(spark):
    from pyspark.sql import functions as F

    u = mixing.uniform(F.lit("x"), F.col("id"))
    mean, var = spark.range(300).select(mixing.poisson(F.lit(2_000.0), u).alias("k")).selectExpr("avg(k)", "var_samp(k)").first()
    assert abs(mean - 2_000) < 15 and 1_300 < var < 2_900


def test_odd_rows_and_same_result_again(odd, empty):
    one, two = (sorted(str(r) for r in mixing.mixed(odd, size=4).collect()) for _ in range(2))
    assert one == two and len(one) > len(ODD)
    assert set(odd.columns) < set(mixing.mixed(odd).columns)
    assert mixing.mixed(empty).count() == 0
    assert mixing.mixed(odd, weights={"other": 1.0}).count() == 0


def test_rates_beyond_the_broadcast_bound(odd, monkeypatch):
    one = sorted(str(r) for r in mixing.mixed(odd, size=4).collect())
    monkeypatch.setattr(mixing, "MAX_BROADCAST", 0)
    assert sorted(str(r) for r in mixing.mixed(odd, size=4).collect()) == one


def test_no_python_on_the_way(odd):
    plan = mixing.mixed(odd)._jdf.queryExecution().toString()
    assert not any(p in plan for p in ("Python", "Pandas", "Arrow"))
