"""Stored unified diffs as rows of files, hunks and lines.

``keys`` must identify a row of the table of diff texts. Files, hunks and lines are cut and numbered inside
the row; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.artifacts import bind
from ..operators.rows import one_row_each

# Fixed value: the header of a hunk.
_HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@ ?(.*)"


def drop_blank(df: DataFrame, text: str) -> DataFrame:
    """Rows whose diff text holds more than blanks; a blank diff means no change."""
    return df.where(F.col(text).rlike(r"\S"))


def _file_chunks(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    chunks = F.filter(
        F.split(F.col(text), r"(?md)^(?=diff --git )", -1), lambda c: F.startswith(c, F.lit("diff --git "))
    )
    rows = one_row_each(drop_blank(df, text), keys, chunks, "chunk", "file_no")
    parts = F.split("chunk", r"(?md)^(?=@@ )", -1)
    return rows.select(*keys, "file_no", F.element_at(parts, 1).alias("head"), F.slice(parts, F.lit(2), F.size(parts) - 1).alias("hunks"))


def _head(start: str, rest: str = "(.+)") -> Column:
    """What follows ``start`` on the first line that begins with it; the search is skipped where it is absent."""
    found = F.regexp_extract("head", rf"(?md)^{start}{rest}\r?$", 1)
    return F.when(F.contains("head", F.lit(start)) & (found != ""), found)


def _path(mark: str, letter: str, moved: str) -> Column:
    """From the rename or copy line, else the ---/+++ line, else the first line."""
    return F.when(F.contains("head", F.lit('"')), _quoted_path(mark, letter, moved)).otherwise(_plain_path(mark, letter, moved))


def _plain_path(mark: str, letter: str, moved: str) -> Column:
    first = F.regexp_extract("head", r"^diff --git a/(.+) b/(.+?)\r?(?:\n|\z)", 1 if letter == "a" else 2)
    marked = F.regexp_extract("head", rf"(?md)^{mark} (/dev/null|{letter}/.+?)\t?\r?$", 1)
    return F.coalesce(
        _head(f"rename {moved} ", "(.+?)"),
        _head(f"copy {moved} ", "(.+?)"),
        F.when(marked != "", F.regexp_replace(marked, f"^{letter}/", "")),
        first,
    )


def _quoted_path(mark: str, letter: str, moved: str) -> Column:
    """Names with unusual characters stand in quotes; either name of a line may."""
    name = rf'(?:"{letter}/((?:[^"\\]|\\.)+)"|{letter}/(.+?))'
    a, b = (name if x == letter else rf'(?:"{x}/(?:[^"\\]|\\.)+"|{x}/.+)' for x in "ab")
    first = _either("head", rf"^diff --git {a} {b}\r?(?:\n|\z)")
    marked = _either("head", rf"(?md)^{mark} {name}\t?\r?$")
    gone = F.when(F.col("head").rlike(rf"(?md)^{mark} /dev/null\t?\r?$"), "/dev/null")
    plain = r'(?:"((?:[^"\\]|\\.)+)"|(.+?))'
    return F.coalesce(
        *[F.when(F.contains("head", F.lit(f"{verb} {moved} ")), _either("head", rf"(?md)^{verb} {moved} {plain}\r?$")) for verb in ("rename", "copy")],
        gone,
        marked,
        first,
    )


# What a letter after a backslash stands for in a quoted name, as hexadecimal bytes.
_ESCAPED = {"a": "07", "b": "08", "t": "09", "n": "0A", "v": "0B", "f": "0C", "r": "0D"}


def unquoted(name: Column) -> Column:
    """A quoted name without its escapes: octal numbers are bytes of UTF-8, letters are control characters."""
    letters = F.create_map(*[F.lit(x) for pair in _ESCAPED.items() for x in pair])

    def part(token: Column) -> Column:
        plain = F.hex(F.encode(F.regexp_replace(token, r"^\\(?=.)", ""), "utf-8"))
        octal = F.lpad(F.conv(F.substring(token, 2, 3), 8, 16), 2, "0")
        escape = F.coalesce(F.try_element_at(letters, F.substring(token, 2, 1)), plain)
        return F.when(token.rlike(r"^\\[0-7]{3}$"), octal).when(F.startswith(token, F.lit("\\")), escape).otherwise(plain)

    tokens = F.regexp_extract_all(name, F.lit(r"\\[0-7]{3}|\\.|[^\\]+"), F.lit(0))
    return F.decode(F.unhex(F.array_join(F.transform(tokens, part), "")), "utf-8")


def _either(text: str, pattern: str) -> Column:
    """What the pattern's first group (quoted) or second group (plain) has found; NULL for neither."""
    quoted, plain = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    return F.when(quoted != "", F.when(F.contains(quoted, F.lit("\\")), unquoted(quoted)).otherwise(quoted)).when(plain != "", plain)


def diff_files(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per file: paths, type, modes, revisions, similarity, is_binary."""
    head = F.col("head")

    def has(line: str) -> Column:
        return F.startswith(head, F.lit(line)) | F.contains(head, F.lit("\n" + line))

    kind = (
        F.when(has("new file mode "), "add")
        .when(has("deleted file mode "), "delete")
        .when(has("rename from "), "rename")
        .when(has("copy from "), "copy")
        .otherwise("modify")
    )
    # Values that several columns need are computed in a projection of their own.
    rows = _file_chunks(df, keys, text).select(*keys, "file_no", "head", kind.alias("type"), _head("index ").alias("index"))
    null = F.lit("/dev/null")
    revs = F.split(F.regexp_extract("index", r"^([0-9a-f]+\.\.[0-9a-f]+)", 1), r"\.\.")
    mode = F.regexp_extract("index", r" (\d+)$", 1)
    mode = F.when(mode != "", mode)
    return rows.select(
        *keys,
        "file_no",
        F.when(F.col("type") == "add", null).otherwise(_path("---", "a", "from")).alias("old_path"),
        F.when(F.col("type") == "delete", null).otherwise(_path(r"\+\+\+", "b", "to")).alias("new_path"),
        "type",
        F.coalesce(_head("old mode "), _head("deleted file mode "), mode).alias("old_mode"),
        F.coalesce(_head("new mode "), _head("new file mode "), mode).alias("new_mode"),
        F.try_element_at(revs, F.lit(1)).alias("old_rev"),
        F.try_element_at(revs, F.lit(2)).alias("new_rev"),
        _head("similarity index ", r"(\d+)%").cast("int").alias("similarity"),
        (has("GIT binary patch") | (has("Binary files ") & head.rlike(r"(?md)^Binary files .* differ\r?$"))).alias("is_binary"),
    )


def _hunks(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    rows = one_row_each(_file_chunks(df, keys, text), [*keys, "file_no"], F.col("hunks"), "hunk", "hunk_no")

    def length(group: int) -> Column:
        found = F.regexp_extract("hunk", _HUNK, group)
        return F.when(found == "", 1).otherwise(found.try_cast("int"))

    return rows.select(
        *keys,
        "file_no",
        "hunk_no",
        F.regexp_extract("hunk", _HUNK, 1).try_cast("int").alias("old_start"),
        length(2).alias("old_lines"),
        F.regexp_extract("hunk", _HUNK, 3).try_cast("int").alias("new_start"),
        length(4).alias("new_lines"),
        F.regexp_extract("hunk", _HUNK, 5).alias("header"),
        "hunk",
    )


def diff_hunks(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per hunk: start and length on both sides, and the text after the second ``@@``."""
    return _hunks(df, keys, text).drop("hunk")


def _numbered(body: Column) -> Column:
    """The lines of a hunk with their numbers. All within the row.

    The j-th line that is on a side has number start + j there. Both sides are listed in order and sorted
    together by position, so a line that is on both sides has two neighbouring items.
    """
    indexed = F.transform(body, lambda s, i: F.struct(i.alias("at"), s.alias("line")))
    none = F.lit(None).cast("int")

    def side(items: Column, absent: str, old: bool) -> Column:
        start = F.col("old_start" if old else "new_start")
        there = F.filter(items, lambda x: ~F.startswith(x["line"], F.lit(absent)))
        return F.transform(
            there,
            lambda x, j: F.struct(
                x["at"].alias("at"),
                (start + j if old else none).alias("old"),
                (none if old else start + j).alias("new"),
                x["line"].alias("line"),
            ),
        )

    def joined(items: Column) -> Column:
        # NULL sorts first: the item with the new number comes before the one with the old number.
        def one(i: Column) -> Column:
            item, following = F.element_at(items, i), F.try_element_at(items, i + 1)
            twin = following["at"].eqNullSafe(item["at"])
            return F.struct(
                item["at"].alias("line_no"),
                item["line"].alias("line"),
                F.coalesce(item["old"], F.when(twin, following["old"])).alias("old_line"),
                item["new"].alias("new_line"),
                ((i == 1) | (F.element_at(items, F.greatest(i - 1, F.lit(1)))["at"] != item["at"])).alias("first"),
            )

        return F.when(
            F.size(items) > 0, F.filter(F.transform(F.sequence(F.lit(1), F.size(items)), one), lambda x: x["first"])
        )

    both = bind(indexed, lambda items: F.sort_array(F.concat(side(items, "+", True), side(items, "-", False))))
    return bind(both, joined)


_SIZES = ["old_start", "old_lines", "new_start", "new_lines"]


def diff_lines(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per line: insert, delete or normal, its text, and its line number on each side it is on."""
    lines = F.split(F.regexp_replace("hunk", r"\n\z", ""), "\n", -1)
    body = F.filter(F.slice(lines, F.lit(2), F.size(lines) - 1), lambda s: ~F.startswith(s, F.lit("\\")))
    hunks = _hunks(df, keys, text)
    rows = one_row_each(hunks, [*keys, "file_no", "hunk_no", *_SIZES], _numbered(body), "l")
    # The header says how many lines there are; a mail's signature may follow the last one.
    for side in ("old", "new"):
        rows = rows.where(F.expr(f"l.{side}_line IS NULL OR l.{side}_line < {side}_start + {side}_lines"))
    kind = F.when(F.col("l.old_line").isNull(), "insert").when(F.col("l.new_line").isNull(), "delete").otherwise("normal")
    return rows.select(
        *keys,
        "file_no",
        "hunk_no",
        "l.line_no",
        kind.alias("type"),
        F.substring("l.line", 2, 2147483647).alias("content"),
        "l.old_line",
        "l.new_line",
    )


def hunk_counts(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of each hunk on the old and the new side, with inserts and deletes."""
    return lines.groupBy(*keys, "file_no", "hunk_no").agg(
        F.count_if(F.col("type") != "insert").alias("old_lines"),
        F.count_if(F.col("type") != "delete").alias("new_lines"),
        F.count_if(F.col("type") == "insert").alias("inserted"),
        F.count_if(F.col("type") == "delete").alias("deleted"),
    )


def file_counts(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Inserted and deleted lines and hunks of each file."""
    return lines.groupBy(*keys, "file_no").agg(
        F.count_if(F.col("type") == "insert").alias("inserted"),
        F.count_if(F.col("type") == "delete").alias("deleted"),
        (F.max("hunk_no") + 1).alias("hunks"),
    )
