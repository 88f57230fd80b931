"""Pairs within a row against a stack, nested elements, and time that does not grow with the square."""

import random
import time

import pytest
from pyspark.sql import functions as F

from changelens.functions.pairing import outermost, pairs, running
from changelens.functions.xmlx import element_markup


def by_stack(kinds):
    found, waiting = [], []
    for i, kind in enumerate(kinds):
        if kind == 1:
            waiting.append(i)
        elif kind == -1 and waiting:
            found.append((waiting.pop(), i))
    return sorted(found)


def outer(found):
    return [p for p in found if not any(q[0] < p[0] and p[1] < q[1] for q in found)]


def test_against_a_stack(spark):
    draw = random.Random(7)
    rows = [(n, [draw.choice([1, -1, 0]) for _ in range(draw.randrange(40))]) for n in range(400)] + [(400, []), (401, [1] * 70), (402, [-1] * 70)]
    found = pairs(F.col("kinds"))
    df = spark.createDataFrame(rows, "n int, kinds array<int>").select(
        "kinds", found.alias("pairs"), outermost(found).alias("outer"), running(F.col("kinds"), F.greatest).alias("top")
    )
    for row in df.collect():
        want = by_stack(row["kinds"])
        assert [tuple(p) for p in row["pairs"]] == want and [tuple(p) for p in row["outer"]] == outer(want)
        assert row["top"] == [max(row["kinds"][: i + 1]) for i in range(len(row["kinds"]))]


@pytest.mark.parametrize(
    ("text", "elements"),
    [
        ("<div>a<div>b</div>c</div>d<div>e</div>", ["<div>a<div>b</div>c</div>", "<div>e</div>"]),
        ("<div><div>in</div>", ["<div>in</div>"]),
        ("</div><div>x</div></div><div>y</div>", ["<div>x</div>", "<div>y</div>"]),
        ("<div a='>'/><div/><divx>n</divx><div\nb=it's>t</div\n>", ["<div a='>'/>", "<div/>", "<div\nb=it's>t</div\n>"]),
        ("<div><!-- </div> --><![CDATA[<div>]]></div>", ["<div><!-- </div> --><![CDATA[<div>]]></div>"]),
        ("<div <div>z</div> <div", ["<div>z</div>"]),
        ("<!-- <div></div>", []),
        ("<div><div/></div>", ["<div><div/></div>"]),
        ("no tags", []),
        ("", []),
        (None, None),
    ],
)
def test_elements(spark, text, elements):
    assert spark.createDataFrame([(text,)], "t string").select(element_markup(F.col("t"), "div")).first()[0] == elements


@pytest.mark.parametrize("unit", ["<a>x</a>", "<a>", "</a>", "<a ", "<", "<a b='x'>y"])
def test_time_follows_the_length(spark, unit):
    def seconds(times):
        df = spark.createDataFrame([(1,)], "n int").select(F.expr("repeat(:u, :n)".replace(":u", repr(unit) if "'" not in unit else '"' + unit + '"').replace(":n", str(times))).alias("t"))
        start = time.perf_counter()
        df.select(F.size(element_markup(F.col("t"), "a"))).collect()
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(40_000) < 3 * min(seconds(20_000) for _ in range(2)) + 1


def test_no_python(spark):
    plan = spark.createDataFrame([("",)], "t string").select(element_markup(F.col("t"), "a"))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()


def test_two_running_values_and_plain_sorts_do(spark):
    found = spark.createDataFrame([("",)], "t string").select(element_markup(F.col("t"), "a"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 4  # six with a third running value
    assert "array_sort(" not in plan  # its comparisons are made in a lambda
