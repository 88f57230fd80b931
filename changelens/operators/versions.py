"""Choosing rows by order: version pairs, first open item, last by name, first of many."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import HOT_ROWS, with_previous


def version_pairs(
    df: DataFrame, keys: list[str], order: list[str], content: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Each version of a key with the content before it; the first version has none and is left out."""
    marker = order[0]
    paired = with_previous(df, keys, order, {content: "old_content", marker: "__before"}, hot_rows)
    return (
        paired.where(F.col("__before").isNotNull())
        .select(*keys, *order, "old_content", F.col(content).alias("new_content"))
    )


def first_open(df: DataFrame, keys: list[str], is_open, order: list, value: list[str]) -> DataFrame:
    """The open row of each key with the greatest ``order``; keys without an open row have none."""
    best = F.max_by(F.struct(*value), F.struct(*order))
    return df.where(is_open).groupBy(*keys).agg(best.alias("__best")).select(*keys, "__best.*")


def last_by_key(df: DataFrame, keys: list[str], order: list, value: list[str]) -> DataFrame:
    """The last row of each key. Only the running best of a key is kept, so large keys cost nothing extra."""
    best = F.max_by(F.struct(*value), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("__best")).select(*keys, "__best.*")


def first_with_alternatives(df: DataFrame, group: str, name: str, order: list) -> DataFrame:
    """Every candidate with the chosen (first) one of its group and the number of candidates.

    The names to list in a warning are rows, not one array per group, so a group may be of any size.
    """
    chosen = df.groupBy(group).agg(
        F.min_by(name, F.struct(*order)).alias("chosen"), F.count(F.lit(1)).alias("candidates")
    )
    return df.select(group, name).join(chosen, group)
