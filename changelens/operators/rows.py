"""Rows from arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_row_each(df: DataFrame, keep: list, items: Column, name: str, position: str | None = None) -> DataFrame:
    """One row per array item with the kept columns; empty arrays have none. Items must not be NULL.

    A plain explode makes the optimizer test the array for emptiness first, which computes an expensive array
    twice or more. The outer form computes it once and drops the empty ones afterwards.
    """
    if position is None:
        return df.select(*keep, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())
    return df.select(*keep, F.posexplode_outer(items).alias(position, name)).where(F.col(position).isNotNull())


def dealt_out(df: DataFrame) -> DataFrame:
    """The same rows over as many tasks as a shuffle has, for heavy work on each row of a narrow table.

    A compressed table of a few megabytes is one or two file splits, however many rows it holds.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
