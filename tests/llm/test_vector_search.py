"""The search against all products, and the bounds it prunes by."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelens.llm import vector_search
from changelens.llm.vector_search import Best, Block, statistics

VECTORS = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]
    + [T.StructField(n, T.StringType()) for n in ("chunk", "query_block", "score", "rank", "kind")]
)


def table(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c", "d", "e") for i, v in rows], VECTORS)


def brute(rows, every, k):
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    found = []
    for a, (i, q) in enumerate(sound):
        if i is None or i % every:
            continue
        scores = [(-max(min(sum(x * y for x, y in zip(q, v)), 2**63 - 1), -(2**63)), j is None, j or 0) for b, (j, v) in enumerate(sound) if a != b]
        found += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(sorted(scores)[:k])]
    return sorted(found, key=str)


def made(spark, rows, every=50, k=5):
    found = vector_search.top_k(table(spark, rows), F.col("vec_id") % every == 0, k)
    assert [t for _, t in found.dtypes] == ["bigint", "int", "bigint", "bigint"]
    return sorted(map(tuple, found.collect()), key=str)


def random_rows(n, width, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, width))
    return [(i, [float(np.float32(x)) for x in centres[i % 7] + 0.3 * rng.normal(size=width)]) for i in range(n)]


@pytest.mark.parametrize("width", [1, 3, 16, 37])
def test_against_all_products(spark, width):
    rows = random_rows(400, width, width)
    assert made(spark, rows) == brute(rows, 50, 5)


def test_small_blocks_give_the_same(spark, monkeypatch):
    rows = random_rows(300, 16, 1)
    whole = made(spark, rows, every=3)
    for name, value in (("ROWS", 20), ("QUERY_ROWS", 7), ("CHUNK", 2), ("PAIRS", 64), ("BATCH", 2), ("FIRST", 1)):
        monkeypatch.setattr(vector_search, name, value)
    assert made(spark, rows, every=3) == whole == brute(rows, 3, 5)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (50, [0.0, 0.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [1.0, -inf])]
    rows += [(None, [1.0, 0.5]), (7, [1.0, 0.5]), (7, [1.0, 0.5]), (6, [1.0, 0.5]), (8, []), (100, [2.0]), (-50, [3.0, 1.0, 4.0])]
    got = made(spark, rows)
    assert got == brute(rows, 50, 5) and len(got) == 25
    assert made(spark, []) == [] and made(spark, [(0, [1.0])]) == []
    assert made(spark, [(0, [1.0]), (1, [1.0])]) == [(0, 1, 1, 65536)]


def test_large_numbers(spark):
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(([1e12, 1.0], [1e12, 3.0], [1e12, 2.0], [3e38, 1.0], [-3e38, 1.0]))]
    assert made(spark, rows) == brute(rows, 50, 5)


def test_many_ties(spark):
    rows = [(i, [0.5, 0.25, -0.5]) for i in range(300)] + [(i, [0.1, 0.1, 0.1]) for i in range(300, 330)]
    assert made(spark, rows) == brute(rows, 50, 5)


def test_bounds_hold_and_grow_finer():
    rng = np.random.default_rng(3)
    x, y = np.floor(256 * rng.normal(size=(50, 64))), np.floor(256 * rng.normal(size=(60, 64)))
    true, before = ((x[:, None] - y[None]) ** 2).sum(2), -1.0
    for segments in vector_search.LEVELS:
        squares = (x * x).sum(1)[:, None] + (y * y).sum(1)[None]
        lower = vector_search.lower_distances(statistics(x, segments), statistics(y, segments), squares)
        assert (lower <= true + 1e-6).all() and lower.mean() > before
        before = lower.mean()


def test_few_pairs_are_compared_in_full():
    rng = np.random.default_rng(5)
    walks = np.floor(256 * np.cumsum(rng.normal(size=(3000, 64)), axis=1))
    block = Block(np.arange(3000), np.ones(3000, bool), np.arange(3000), walks)
    asked = Block(np.arange(30), np.ones(30, bool), np.arange(30), walks[:30])
    best = Best(asked, 5)
    assert best.search(block) < 0.2 * 30 * 3000
    assert (best.score.reshape(30, 5) == np.sort((walks[:30] @ walks.T - np.diag([math.inf] * 3000)[:30].clip(0)), axis=1)[:, ::-1][:, :5]).all()
