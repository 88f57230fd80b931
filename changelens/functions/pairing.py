"""Opening and closing signs of one row paired by built-in functions.

A fold that appends to an array copies the array for every item. Running values are therefore made by doubling: after
step s every item has taken in the s items before it, so n items need log n passes over the array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .artifacts import bind

_STEPS = [1 << k for k in range(31)]


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Each item combined with all items before it; ``combine`` has to be associative."""

    def pass_(step: Column, done: Column) -> Column:
        return F.transform(done, lambda x, i: F.when(i >= step, combine(F.get(done, i - step), x)).otherwise(x))

    def made(v: Column) -> Column:
        passes = F.length(F.bin(F.greatest(F.size(v) - 1, F.lit(0))))  # as many as the last index has bits
        return F.aggregate(F.slice(F.array(*[F.lit(s) for s in _STEPS]), F.lit(1), passes), v, lambda done, step: pass_(step, done))

    return bind(values, made)


def pairs(kinds: Column) -> Column:
    """``array<struct(first, last)>``: the indexes of openings (1) and the closings (-1) that belong to them.

    Items of kind 0 are neither. Closings without an opening and openings without a closing are in no pair and
    do not disturb the others: on every level openings and closings take turns, so sorting by level and place
    brings the two of a pair together. Levels below the ground begin with a closing that has no
    opening. Items of kind 0 are left out first. The pairs are in order of their openings.
    """

    def by_level(marks: Column, sums: Column) -> Column:
        # Both of a pair have the sum between them as their level: after the opening, before the closing.
        entries = F.transform(
            marks, lambda m, i: F.struct((F.get(sums, i) + F.when(m["kind"] == -1, 1).otherwise(0)).alias("level"), m["place"].alias("place"), m["kind"].alias("kind"))
        )
        return bind(F.sort_array(entries), neighbours)

    def neighbours(entries: Column) -> Column:
        both = F.transform(entries, lambda e, i: F.struct(e.alias("a"), F.get(entries, i + 1).alias("b")))
        joined = F.filter(both, lambda p: (p["a"]["kind"] == 1) & (p["b"]["kind"] == -1) & (p["a"]["level"] == p["b"]["level"]))
        return F.sort_array(F.transform(joined, lambda p: F.struct(p["a"]["place"].alias("first"), p["b"]["place"].alias("last"))))

    placed = F.transform(kinds, lambda k, i: F.struct(i.alias("place"), k.alias("kind")))
    return bind(
        F.filter(placed, lambda m: m["kind"] != 0),
        lambda marks: bind(running(F.transform(marks, lambda m: m["kind"]), lambda a, b: a + b), lambda sums: by_level(marks, sums)),
    )


def outermost(found: Column) -> Column:
    """The pairs, in order of their openings, that lie in no other pair."""

    def kept(all_: Column, ends: Column) -> Column:
        return F.filter(all_, lambda p, i: (i == 0) | (p["first"] > F.get(ends, i - 1)))

    return bind(found, lambda all_: bind(running(F.transform(all_, lambda p: p["last"]), F.greatest), lambda ends: kept(all_, ends)))
