"""Match spans: offsets, maximal spans, first-seen nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import HOT_ROWS, with_earlier_max
from .rows import one_row_each


def match_spans(df: DataFrame, keys: list[str], text: str, pattern: str) -> DataFrame:
    """``keys, pos, start, end, match`` of every match; offsets count characters from 0, ``end`` is exclusive.

    ``keys`` must identify a row of ``df``. The pattern must not match the empty text.
    """
    gaps = F.split(F.col(text), pattern, -1)
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    # Without a limit of matches both arrays line up: n + 1 gaps around n matches.
    pieces = F.arrays_zip(gaps.alias("gap"), found.alias("match"))
    rows = one_row_each(df, keys, pieces, "piece", "pos").where(F.col("piece.match").isNotNull())
    upto = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    length = F.length("piece.match")
    checked = F.when(length > 0, length).otherwise(F.raise_error(F.lit("the pattern matches the empty text")).cast("int"))
    end = F.sum(F.length("piece.gap") + checked).over(upto)
    return rows.select(
        *keys, "pos", (end - length).alias("start"), end.alias("end"), F.col("piece.match").alias("match")
    )


def maximal_spans(
    spans: DataFrame, match: str, start: str, end: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The spans that lie strictly inside no other span of their match; equal spans all stay.

    A span is inside another one if an earlier start reaches at least as far, or the same start reaches
    further. So the furthest end per start and the furthest end of all earlier starts decide, without
    comparing spans in pairs.
    """
    furthest = spans.groupBy(match, start).agg(F.max(end).alias("__same"))
    furthest = with_earlier_max(furthest, [match], [start], "__same", "__earlier", hot_rows)
    inside = (F.col("__same") > F.col(end)) | F.coalesce(F.col("__earlier") >= F.col(end), F.lit(False))
    return spans.join(furthest, [match, start]).where(~inside).select(*spans.columns)


def first_seen(spans: DataFrame, keys: list[str], order: list[str], value: list[str]) -> DataFrame:
    """The first row of each (side, node), with its position."""
    best = F.min_by(F.struct(*order, *value), F.struct(*order))
    return spans.groupBy(*keys).agg(best.alias("__first")).select(*keys, "__first.*")
