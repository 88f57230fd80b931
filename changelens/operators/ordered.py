"""Ordered computations per key that do not put one key into one task.

Ranks, previous rows and running maxima need the rows of a key in order. For keys of ordinary size a window
does that. A key with more than ``hot_rows`` rows is cut into range partitions instead: each partition is
worked on by itself, and one small row per (key, partition) carries the result over to the next partition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

HOT_ROWS = 1_000_000
MAX_BROADCAST_KEYS = 100_000
_CHUNK = "__chunk"


def _same(left: str, right: str, keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return on


def _cut_hot(df: DataFrame, keys: list[str], order: list[str], hot_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of ordinary keys, and the rows of hot keys cut into ordered chunks (None when there are none)."""
    hot = df.groupBy(*keys).count().where(F.col("count") > hot_rows)
    found = hot.agg(F.count(F.lit(1)).alias("keys"), F.sum("count").alias("rows")).first()
    if found["keys"] == 0:
        return df, None
    total, hot = found["rows"], checkpointed(hot.select(*keys))
    # Few keys can be hot. Should there be many, no single one weighs enough to matter in a shuffle.
    if found["keys"] <= MAX_BROADCAST_KEYS:
        hot = F.broadcast(hot)
    cold = df.alias("d").join(hot.alias("h"), _same("d", "h", keys), "left_anti")
    rows = df.alias("d").join(hot.alias("h"), _same("d", "h", keys), "left_semi")
    chunks = max(2, -(-int(total) // hot_rows) * 2)
    # The chunk borders come from a sample, so they are fixed by writing the rows down once.
    return cold, checkpointed(
        rows.repartitionByRange(chunks, *keys, *order).withColumn(_CHUNK, F.spark_partition_id())
    )


def _carry(
    hot: DataFrame, keys: list[str], carried: Column, combine: Callable[[Column, Window], Column]
) -> DataFrame:
    """Join to each row what the earlier chunks of its key hand over, as column ``__carry``."""
    each = hot.groupBy(*keys, _CHUNK).agg(carried.alias("__part"))
    # One row per key and chunk: a key has at most as many as there are chunks.
    earlier = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    handed = each.select(*keys, _CHUNK, combine(F.col("__part"), earlier).alias("__carry"))
    joined = hot.alias("d").join(handed.alias("c"), _same("d", "c", [*keys, _CHUNK]), "left")
    return joined.select("d.*", "c.__carry")


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str = "rank", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add the 1-based position of each row within its key. ``order`` must be unique within a key."""
    cold, hot = _cut_hot(df, keys, order, hot_rows)
    whole = Window.partitionBy(*keys).orderBy(*order)
    out = cold.withColumn(name, F.row_number().over(whole).cast("bigint"))
    if hot is None:
        return out
    inside = Window.partitionBy(*keys, _CHUNK).orderBy(*order)
    rows = _carry(hot, keys, F.count(F.lit(1)), lambda part, w: F.sum(part).over(w))
    rows = rows.withColumn(name, F.row_number().over(inside) + F.coalesce("__carry", F.lit(0)))
    return out.unionByName(rows.drop(_CHUNK, "__carry"))


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add the values of the previous row of the same key; ``columns`` maps source to new name."""
    cold, hot = _cut_hot(df, keys, order, hot_rows)
    whole = Window.partitionBy(*keys).orderBy(*order)
    out = cold.select("*", *[F.lag(c).over(whole).alias(n) for c, n in columns.items()])
    if hot is None:
        return out
    inside = Window.partitionBy(*keys, _CHUNK).orderBy(*order)
    last = F.max_by(F.struct(*columns), F.struct(*order))
    rows = _carry(hot, keys, last, lambda part, w: F.last(part, ignorenulls=True).over(w))
    rows = rows.withColumn("__first", F.row_number().over(inside) == 1)
    rows = rows.select(
        "*",
        *[
            F.when(F.col("__first"), F.col(f"__carry.{c}")).otherwise(F.lag(c).over(inside)).alias(n)
            for c, n in columns.items()
        ],
    )
    return out.unionByName(rows.drop(_CHUNK, "__carry", "__first"))


def with_earlier_max(
    df: DataFrame, keys: list[str], order: list[str], column: str, name: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add the maximum of ``column`` over all earlier rows of the same key (NULL on the first)."""
    cold, hot = _cut_hot(df, keys, order, hot_rows)
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = cold.withColumn(name, F.max(column).over(before))
    if hot is None:
        return out
    inside = Window.partitionBy(*keys, _CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = _carry(hot, keys, F.max(column), lambda part, w: F.max(part).over(w))
    rows = rows.withColumn(name, F.greatest(F.max(column).over(inside), F.col("__carry")))
    return out.unionByName(rows.drop(_CHUNK, "__carry"))
