"""Line differences of two texts in a row."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.artifacts import bind
from .rows import one_row_each

CONTEXT_LINES = 3
NO_NEWLINE = "\n\\ No newline at end of file"


def text_lines(text: Column) -> Column:
    """The lines of a text. A last line without newline carries the marker, so it differs from one with it."""
    ended = F.endswith(text, F.lit("\n"))
    parts = F.split(text, "\n", -1)
    body = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    marked = F.concat(F.element_at(parts, -1), F.lit(NO_NEWLINE))
    return F.when(text == "", F.array().cast("array<string>")).when(ended, body).otherwise(
        F.concat(body, F.array(marked))
    )


def common_edges(left: Column, right: Column) -> Column:
    """``struct(prefix, suffix)``: equal items at the start, and at the end of what remains; never overlapping."""
    shorter = F.least(F.size(left), F.size(right))

    def run(a: Column, b: Column, most: Column) -> Column:
        same = F.zip_with(F.slice(a, F.lit(1), most), F.slice(b, F.lit(1), most), lambda x, y: x == y)
        return bind(F.array_position(same, F.lit(False)), lambda miss: F.when(miss > 0, miss.cast("int") - 1).otherwise(most))

    def edges(prefix: Column) -> Column:
        suffix = run(F.reverse(left), F.reverse(right), shorter - prefix)
        return F.struct(prefix.alias("prefix"), suffix.alias("suffix"))

    return bind(run(left, right, shorter), edges)


def _changed_region(df: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """Rows whose texts differ, with the lines of both sides and the common edges; all within the row."""
    return (
        df.where(F.col(left) != F.col(right))
        .select(*keys, text_lines(F.col(left)).alias("__l"), text_lines(F.col(right)).alias("__r"))
        .withColumn("__e", common_edges(F.col("__l"), F.col("__r")))
    )


def _middle(side: str) -> Column:
    p, s = F.col("__e.prefix"), F.col("__e.suffix")
    return F.slice(side, p + 1, F.size(side) - p - s)


def _region_lines(df: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """``op, line_no, line`` for the lines between the common edges, both sides."""

    def side(name: str, op: str) -> Column:
        return F.transform(
            _middle(name),
            lambda s, i: F.struct(F.lit(op).alias("op"), (i + F.col("__e.prefix") + 1).alias("line_no"), s.alias("line")),
        )

    region = _changed_region(df, keys, left, right)
    return one_row_each(region, keys, F.concat(side("__l", "-"), side("__r", "+")), "x").select(*keys, "x.*")


def line_diff(df: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """``-`` and ``+`` lines as a multiset difference with 1-based positions.

    Between the common first and last lines, the n-th occurrence of a line on one side cancels the n-th on the
    other. Only that region is shuffled, once, by row and line; a group is one line text of one row.
    """
    rows = _region_lines(df, keys, left, right)
    line = [*keys, "line"]
    nth = F.row_number().over(Window.partitionBy(*line, "op").orderBy("line_no"))
    other = F.when(F.col("op") == "-", F.count_if(F.col("op") == "+").over(Window.partitionBy(*line))).otherwise(
        F.count_if(F.col("op") == "-").over(Window.partitionBy(*line))
    )
    kept = rows.select(*keys, "op", "line_no", "line", nth.alias("__n"), other.alias("__other"))
    return kept.where(F.col("__n") > F.col("__other")).drop("__n", "__other")


def line_counts_diff(df: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """The multiset difference without positions: ``op, line, n``; summed before the shuffle."""
    rows = _region_lines(df, keys, left, right)
    change = F.sum(F.when(F.col("op") == "-", -1).otherwise(1))
    summed = rows.groupBy(*keys, "line").agg(change.alias("n")).where("n <> 0")
    return summed.select(*keys, F.when(F.col("n") < 0, "-").otherwise("+").alias("op"), "line", F.abs("n").alias("n"))


def _unified_range(first: Column, count: Column) -> Column:
    return F.when(count == 1, first.cast("string")).otherwise(F.concat_ws(",", first.cast("string"), count.cast("string")))


def _hunk_header(h: Column) -> Column:
    return F.concat(
        F.lit("@@ -"),
        _unified_range(h["old_start"], h["old_lines"]),
        F.lit(" +"),
        _unified_range(h["new_start"], h["new_lines"]),
        F.lit(" @@"),
    )


def _bounds(left: Column, right: Column, edges: Column) -> Column:
    before = F.least(edges["prefix"], F.lit(CONTEXT_LINES))
    after = F.least(edges["suffix"], F.lit(CONTEXT_LINES))
    first = edges["prefix"] - before + 1
    old = F.size(left) - edges["prefix"] - edges["suffix"] + before + after
    new = F.size(right) - edges["prefix"] - edges["suffix"] + before + after
    return F.struct(
        F.when(old == 0, F.lit(0)).otherwise(first).alias("old_start"),
        old.alias("old_lines"),
        F.when(new == 0, F.lit(0)).otherwise(first).alias("new_start"),
        new.alias("new_lines"),
    )


def _marked(mark: str, lines: Column) -> Column:
    return F.transform(lines, lambda s: F.concat(F.lit(mark), s))


def with_hunk(df: DataFrame, left: str, right: str, prefix: str = "") -> DataFrame:
    """Add ``hunk`` (bounds) and ``diff_text`` of the one hunk that covers all changes; stays in the row."""
    out = df.withColumn("__l", text_lines(F.col(left))).withColumn("__r", text_lines(F.col(right)))
    out = out.withColumn("__e", common_edges(F.col("__l"), F.col("__r")))
    out = out.withColumn(f"{prefix}hunk", _bounds(F.col("__l"), F.col("__r"), F.col("__e")))
    p, s = F.col("__e.prefix"), F.col("__e.suffix")
    before, after = F.least(p, F.lit(CONTEXT_LINES)), F.least(s, F.lit(CONTEXT_LINES))
    lines = F.concat(
        _marked(" ", F.slice("__l", p - before + 1, before)),
        _marked("-", F.slice("__l", p + 1, F.size("__l") - p - s)),
        _marked("+", F.slice("__r", p + 1, F.size("__r") - p - s)),
        _marked(" ", F.slice("__l", F.size("__l") - s + 1, after)),
    )
    text = F.concat(_hunk_header(F.col(f"{prefix}hunk")), F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n"))
    return out.withColumn(f"{prefix}diff_text", text).drop("__l", "__r", "__e")


def hunk_bounds(df: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """Bounds of the hunk between the common first and last lines, with three lines of context."""
    changed = df.where(F.col(left) != F.col(right))
    return with_hunk(changed, left, right).select(*keys, "hunk.*")


def unified_text(df: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """Unified text of that hunk, without the two file header lines."""
    changed = df.where(F.col(left) != F.col(right))
    return with_hunk(changed, left, right).select(*keys, "diff_text")


# Fixed value: the header of a hunk.
_FIRST_HUNK = r"(?m)^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"


def line_range(diff_text: Column) -> Column:
    """``struct(start, end)`` on the new side of the first hunk of a unified text; NULL without a hunk."""
    start = F.regexp_extract(diff_text, _FIRST_HUNK, 1).try_cast("int")
    count = F.regexp_extract(diff_text, _FIRST_HUNK, 2)
    length = F.when(count == "", 1).otherwise(count.try_cast("int"))
    return F.when(
        diff_text.rlike(_FIRST_HUNK), F.struct(start.alias("start"), (start + length - 1).alias("end"))
    )


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _longest_increasing(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Indices of a longest increasing subsequence of each array."""

    def indices(values) -> list[int]:
        tails: list[int] = []
        ends: list[int] = []
        back: list[int] = []
        for i, v in enumerate(values):
            k = bisect.bisect_left(tails, v)
            back.append(ends[k - 1] if k else -1)
            tails[k : k + 1] = [v]
            ends[k : k + 1] = [i]
        out, i = [], ends[-1] if ends else -1
        while i >= 0:
            out.append(i)
            i = back[i]
        return out[::-1]

    for series in batches:
        yield series.map(indices)


def _anchors() -> tuple[Column, Callable[[Column], Column]]:
    """The lines that occur once on each side of the changed region, as positions ordered by the left one.

    Both sides are sorted together by line; a line that is unique on both sides is a left item followed by a
    right one, with other lines around them. Everything stays in the row.
    """

    def side(name: str, number: int) -> Column:
        return F.transform(name, lambda s, i: F.struct(s.alias("line"), F.lit(number).alias("side"), i.alias("at")))

    # One item that equals no line at each end, so that every item has neighbours.
    edge = F.array(F.struct(F.lit(None).cast("string").alias("line"), F.lit(0).alias("side"), F.lit(-1).alias("at")))
    merged = F.concat(edge, F.sort_array(F.concat(side("__ml", 0), side("__mr", 1))), edge)

    def unique_pairs(items: Column) -> Column:
        return F.filter(
            F.transform(
                F.sequence(F.lit(2), F.size(items) - 2),
                lambda i: F.struct(
                    F.element_at(items, i)["at"].alias("l"),
                    F.element_at(items, i + 1)["at"].alias("r"),
                    (
                        (F.element_at(items, i)["side"] == 0)
                        & (F.element_at(items, i + 1)["side"] == 1)
                        & (F.element_at(items, i)["line"] == F.element_at(items, i + 1)["line"])
                        & ~F.element_at(items, i - 1)["line"].eqNullSafe(F.element_at(items, i)["line"])
                        & ~F.element_at(items, i + 2)["line"].eqNullSafe(F.element_at(items, i)["line"])
                    ).alias("ok"),
                ),
            ),
            lambda x: x["ok"],
        )

    return merged, unique_pairs


def _hunk(g: Column) -> Column:
    """Bounds and text of the hunk around a run of segments, with its context lines."""
    first, last = F.element_at(g, 1), F.element_at(g, -1)
    before = F.least(F.lit(CONTEXT_LINES), first["l0"])
    after = F.least(F.lit(CONTEXT_LINES), F.size("__l") - last["l1"])
    old = last["l1"] - first["l0"] + before + after
    new = last["r1"] - first["r0"] + before + after

    def body(seg: Column, i: Column) -> Column:
        until = F.coalesce(F.try_element_at(g, i + 2)["l0"], seg["l1"] + after)
        return F.concat(
            _marked("-", F.slice("__l", seg["l0"] + 1, seg["l1"] - seg["l0"])),
            _marked("+", F.slice("__r", seg["r0"] + 1, seg["r1"] - seg["r0"])),
            _marked(" ", F.slice("__l", seg["l1"] + 1, until - seg["l1"])),
        )

    lines = F.concat(_marked(" ", F.slice("__l", first["l0"] - before + 1, before)), F.flatten(F.transform(g, body)))
    return F.struct(
        F.when(old == 0, first["l0"] - before).otherwise(first["l0"] - before + 1).alias("old_start"),
        old.alias("old_lines"),
        F.when(new == 0, first["r0"] - before).otherwise(first["r0"] - before + 1).alias("new_start"),
        new.alias("new_lines"),
        F.array_join(lines, "\n").alias("body"),
    )


def with_hunks(df: DataFrame, left: str, right: str) -> DataFrame:
    """Add ``hunks``: several hunks per row where unchanged lines lie between the changes.

    Inside the trimmed region the lines that occur once on both sides and keep their order are anchors;
    between two anchors the common edges are trimmed again. Nothing is shuffled; only the positions of the
    anchors go through Python, for their longest increasing run.
    """
    kept = df.columns
    rows = df.select("*", text_lines(F.col(left)).alias("__l"), text_lines(F.col(right)).alias("__r"))
    rows = rows.withColumn("__e", common_edges(F.col("__l"), F.col("__r")))
    rows = rows.withColumn("__ml", _middle("__l")).withColumn("__mr", _middle("__r"))
    p = F.col("__e.prefix")
    merged, unique_pairs = _anchors()
    none = F.array().cast("array<struct<l:int,r:int>>")
    both = (F.size("__ml") > 0) & (F.size("__mr") > 0)
    rows = rows.withColumn("__m", F.when(both, merged))
    pairs = F.transform(unique_pairs(F.col("__m")), lambda x: F.struct(x["l"].alias("l"), x["r"].alias("r")))
    rows = rows.withColumn("__a", F.when(both, F.sort_array(pairs)).otherwise(none)).drop("__m")
    rows = rows.withColumn("__k", _longest_increasing(F.col("__a.r")))
    rows = rows.withColumn("__a", F.transform("__k", lambda i: F.element_at("__a", i + 1)))

    def point(l: Column, r: Column) -> Column:
        return F.struct(l.cast("int").alias("l"), r.cast("int").alias("r"))

    ends = F.array(point(F.lit(-1), F.lit(-1))), F.array(point(F.size("__ml"), F.size("__mr")))
    rows = rows.withColumn("__p", F.concat(ends[0], "__a", ends[1]))

    def segment(a: Column, b: Column) -> Column:
        ls = F.slice("__ml", a["l"] + 2, b["l"] - a["l"] - 1)
        rs = F.slice("__mr", a["r"] + 2, b["r"] - a["r"] - 1)
        # One binding of the edges; they are used four times.
        return F.transform(
            F.array(common_edges(ls, rs)),
            lambda e: F.struct(
                (p + a["l"] + 1 + e["prefix"]).alias("l0"),
                (p + b["l"] - e["suffix"]).alias("l1"),
                (p + a["r"] + 1 + e["prefix"]).alias("r0"),
                (p + b["r"] - e["suffix"]).alias("r1"),
            ),
        )[0]

    gaps = F.zip_with(
        F.slice("__p", F.lit(1), F.size("__p") - 1), F.slice("__p", F.lit(2), F.size("__p") - 1), segment
    )
    rows = rows.withColumn("__s", F.filter(gaps, lambda g: (g["l1"] > g["l0"]) | (g["r1"] > g["r0"])))
    # A hunk starts where more unchanged lines lie before a segment than two contexts hold.
    starts = F.filter(
        F.sequence(F.lit(1), F.size("__s")),
        lambda i: (i == 1)
        | (F.element_at("__s", i)["l0"] - F.element_at("__s", F.greatest(i - 1, F.lit(1)))["l1"] > 2 * CONTEXT_LINES),
    )
    rows = rows.withColumn("__h", F.when(F.size("__s") > 0, starts).otherwise(F.array().cast("array<int>")))
    grouped = F.transform(
        "__h",
        lambda start, i: F.slice("__s", start, F.coalesce(F.try_element_at("__h", i + 2), F.size("__s") + 1) - start),
    )
    rows = rows.withColumn("__g", grouped)
    rows = rows.withColumn("__b", F.transform("__g", _hunk))
    hunks = F.transform(
        "__b",
        lambda h: F.struct(
            *[h[c].alias(c) for c in ("old_start", "old_lines", "new_start", "new_lines")],
            F.concat(_hunk_header(h), F.lit("\n"), h["body"], F.lit("\n")).alias("hunk_text"),
        ),
    )
    return rows.select(*kept, hunks.alias("hunks"))


def anchored_diff(df: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """``with_hunks`` as rows: ``hunk_no, old_start, old_lines, new_start, new_lines, hunk_text``."""
    changed = df.where(F.col(left) != F.col(right)).select(*keys, F.col(left).alias("__left"), F.col(right).alias("__right"))
    rows = with_hunks(changed, "__left", "__right")
    return one_row_each(rows, keys, F.col("hunks"), "h", "hunk_no").select(*keys, "hunk_no", "h.*")


def apply_hunks(text: Column, hunks: Column) -> Column:
    """The old text with its hunks (as ``with_hunks`` gives them) applied: the new text. Stays in the row."""

    def first(h: Column) -> Column:
        return F.when(h["old_lines"] == 0, h["old_start"] + 1).otherwise(h["old_start"])

    def new_side(h: Column) -> Column:
        # A line and its mark of a missing newline belong together.
        body = F.split(F.regexp_replace(h["hunk_text"], r"\A[^\n]*\n|\n\z", ""), r"\n(?!\\)", -1)
        return F.transform(F.filter(body, lambda s: ~F.startswith(s, F.lit("-"))), lambda s: F.substring(s, 2, 2147483647))

    def patched(lines: Column) -> Column:
        def piece(h: Column, i: Column) -> Column:
            before = F.get(hunks, i - 1)
            at = F.coalesce(first(before) + before["old_lines"], F.lit(1))
            return F.concat(F.slice(lines, at, first(h) - at), new_side(h))

        last = F.element_at(hunks, -1)
        rest = first(last) + last["old_lines"]
        return F.concat(F.flatten(F.transform(hunks, piece)), F.slice(lines, rest, F.size(lines) - rest + 1))

    whole = bind(F.when(F.size(hunks) > 0, bind(text_lines(text), patched)).otherwise(text_lines(text)), lambda lines: F.when(
        F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(""))
    return F.regexp_replace(whole, r"\n\\ No newline at end of file\n\z", "")
