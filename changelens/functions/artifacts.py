"""The value every extractor returns, and helpers on it.

An artifact is ``struct(text STRING, context ARRAY<STRING>)``. The context holds at most one element per
side: the JSON text of that side's list of maps. A side without any match has an empty context.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_CONTEXT = "array<string>"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def artifact(text: Column, context: Column | None = None) -> Column:
    empty = F.array().cast(NO_CONTEXT)
    return F.struct(
        text.alias("text"), (empty if context is None else F.coalesce(context, empty)).alias("context")
    )


def or_empty(extracted: Column, content: Column) -> Column:
    """NULL or empty content gives the empty artifact; nothing is extracted then."""
    return F.when(F.coalesce(content, F.lit("")) == "", artifact(F.lit(""))).otherwise(extracted)


def join_matches(matches: Column, sep: str = "\n") -> Column:
    """Matches in order with a separator between them and none at the end."""
    return F.array_join(matches, sep)


def merge_context(left: Column, right: Column) -> Column:
    """Distinct union of both sides in left-then-right order as one JSON array; NULL when there is none."""
    both = F.array_distinct(F.concat(left, right))
    return F.when(F.size(both) > 0, F.concat(F.lit("["), F.array_join(both, ","), F.lit("]")))


def merge_maps(*maps: Column) -> Column:
    """Later maps win on equal keys; an empty result is NULL."""

    def without(earlier: Column, later: Column) -> Column:
        return F.map_filter(earlier, lambda k, _: ~F.map_contains_key(later, k))

    merged = maps[0]
    for later in maps[1:]:
        merged = F.map_concat(without(merged, later), later)
    return F.when(F.size(merged) > 0, merged)
