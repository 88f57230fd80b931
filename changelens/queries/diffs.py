"""Line differences and stored diff texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.linediff import anchored_diff, apply_hunks, hunk_bounds, line_counts_diff, line_diff, line_range, unified_text, with_hunks
from ..operators.versions import version_pairs
from ..sources.patches import diff_files, diff_hunks, diff_lines, drop_blank, file_counts, hunk_counts
from . import versions as V
from .registry import query, table

# Modified documents with both texts.
PAIRS = V.DOCS + f""",
texts AS (SELECT path, {V.sql_lines('old_content')} AS l, {V.sql_lines('new_content')} AS r FROM status WHERE type = 'modify')"""


def document_pairs(spark, sf):
    """Documents on both sides; unchanged ones too, the operators drop them."""
    old = V.base_snapshot(spark, sf).withColumnRenamed("content", "old_content")
    new = V.head_snapshot(spark, sf).withColumnRenamed("content", "new_content")
    return old.join(new, "path")


TURN_TEXTS = V.TURNS + f""",
texts AS (SELECT conv_id, turn, {V.sql_lines('old_content')} AS l, {V.sql_lines('new_content')} AS r FROM turns WHERE before IS NOT NULL AND old_content <> new_content)"""


def turn_pairs(spark, sf):
    return version_pairs(table(spark, sf, "conversations"), ["conv_id"], ["turn"], "text")


def _sql_line_rows(keys: str) -> str:
    return f"""
{V.sql_hunks('texts')},
ls AS (SELECT {keys}, l[i] AS line, i AS line_no, row_number() OVER (PARTITION BY {keys}, l[i] ORDER BY i) AS n
  FROM (SELECT *, unnest(range(pre + 1, len(l) - suf + 1)) AS i FROM edges)),
rs AS (SELECT {keys}, r[i] AS line, i AS line_no, row_number() OVER (PARTITION BY {keys}, r[i] ORDER BY i) AS n
  FROM (SELECT *, unnest(range(pre + 1, len(r) - suf + 1)) AS i FROM edges)),
diff AS (SELECT {keys}, '-' AS op, CAST(line_no AS INTEGER) AS line_no, line FROM ls ANTI JOIN rs USING ({keys}, line, n)
  UNION ALL SELECT {keys}, '+', CAST(line_no AS INTEGER), line FROM rs ANTI JOIN ls USING ({keys}, line, n))"""


@query("l1_line_diff", f"WITH {PAIRS}, {_sql_line_rows('path')} SELECT * FROM diff")
def _(spark, sf):
    return line_diff(document_pairs(spark, sf), ["path"], "old_content", "new_content")


@query("l1_turn_lines", f"WITH {TURN_TEXTS}, {_sql_line_rows('conv_id, turn')} SELECT * FROM diff")
def _(spark, sf):
    return line_diff(turn_pairs(spark, sf), ["conv_id", "turn"], "old_content", "new_content")


@query(
    "u2_line_counts",
    f"WITH {PAIRS}, {_sql_line_rows('path')} SELECT path, op, line, count(*) AS n FROM diff GROUP BY ALL",
)
def _(spark, sf):
    return line_counts_diff(document_pairs(spark, sf), ["path"], "old_content", "new_content")


@query(
    "l2_hunk_bounds",
    f"WITH {PAIRS}, {V.sql_hunks('texts')} SELECT path, old_start, old_lines, new_start, new_lines FROM hunks",
)
def _(spark, sf):
    return hunk_bounds(document_pairs(spark, sf), ["path"], "old_content", "new_content")


@query("l3_unified_text", f"WITH {PAIRS}, {V.sql_hunks('texts')} SELECT path, diff_text FROM hunks")
def _(spark, sf):
    return unified_text(document_pairs(spark, sf), ["path"], "old_content", "new_content")


@query("l3_turn_text", f"WITH {TURN_TEXTS}, {V.sql_hunks('texts')} SELECT conv_id, turn, diff_text FROM hunks")
def _(spark, sf):
    return unified_text(turn_pairs(spark, sf), ["conv_id", "turn"], "old_content", "new_content")


@query(
    "l4_line_range",
    f"""WITH {PAIRS}, {V.sql_hunks('texts')} SELECT path, new_start AS "start", new_start + new_lines - 1 AS "end" FROM hunks""",
)
def _(spark, sf):
    texts = unified_text(document_pairs(spark, sf), ["path"], "old_content", "new_content")
    return texts.select("path", line_range(F.col("diff_text")).alias("r")).select("path", "r.*")


# The longest increasing run of anchors has no plain SQL form, but the hunks must turn the old text into the new one.
@query("l5_anchored_diff", f"WITH {V.DOCS} SELECT path, new_content AS patched FROM status WHERE type = 'modify'")
def _(spark, sf):
    pairs = document_pairs(spark, sf).where("old_content <> new_content")
    rows = with_hunks(pairs, "old_content", "new_content")
    return rows.select("path", apply_hunks(F.col("old_content"), F.col("hunks")).alias("patched"))


@query("l5_patched_turns", f"WITH {V.TURNS} SELECT conv_id, turn, new_content AS patched FROM turns WHERE before IS NOT NULL AND old_content <> new_content")
def _(spark, sf):
    rows = with_hunks(turn_pairs(spark, sf).where("old_content <> new_content"), "old_content", "new_content")
    return rows.select("conv_id", "turn", apply_hunks(F.col("old_content"), F.col("hunks")).alias("patched"))


@query(
    "l5_net_lines",
    f"WITH {PAIRS} SELECT path, CAST(len(r) - len(l) AS BIGINT) AS net FROM texts",
)
def _(spark, sf):
    hunks = anchored_diff(document_pairs(spark, sf), ["path"], "old_content", "new_content")
    return hunks.groupBy("path").agg(F.sum(F.col("new_lines") - F.col("old_lines")).alias("net"))


# --- stored diff texts ----------------------------------------------------------------------------------


@query("p7_drop_blank", f"WITH {V.ORDERS} SELECT diff_id FROM o WHERE form < 4")
def _(spark, sf):
    return drop_blank(V.order_diffs(spark, sf), "diff_text").select("diff_id")


@query(
    "s2_diff_files",
    f"""WITH {V.ORDERS} SELECT diff_id, 0 AS file_no,
    CASE WHEN form = 0 THEN '/dev/null' ELSE path END AS old_path,
    CASE form WHEN 1 THEN '/dev/null' WHEN 3 THEN 'done/' || path ELSE path END AS new_path,
    CASE form WHEN 0 THEN 'add' WHEN 1 THEN 'delete' WHEN 2 THEN 'modify' ELSE 'rename' END AS type,
    CASE form WHEN 1 THEN '100644' WHEN 2 THEN '100644' WHEN 3 THEN '100755' END AS old_mode,
    CASE form WHEN 0 THEN '100644' WHEN 2 THEN '100644' WHEN 3 THEN '100755' END AS new_mode,
    CASE form WHEN 0 THEN '0000000' ELSE 'abc1234' END AS old_rev,
    CASE form WHEN 0 THEN 'abc1234' WHEN 1 THEN '0000000' ELSE 'def5678' END AS new_rev,
    CASE form WHEN 3 THEN 95 END AS similarity, false AS is_binary FROM o WHERE form < 4
    UNION ALL SELECT diff_id, 1, 'logo.png', 'logo.png', 'modify', '100644', '100644', '1111111', '2222222', NULL, true FROM o WHERE form = 3""",
)
def _(spark, sf):
    return diff_files(V.order_diffs(spark, sf), ["diff_id"], "diff_text")


@query(
    "s3_diff_hunks",
    f"""WITH {V.ORDERS}, shape(form, hunk_no, old_start, old_lines, new_start, new_lines) AS (VALUES (0, 0, 0, 0, 1, 2), (1, 0, 1, 1, 0, 0),
    (2, 0, 10, 3, 10, 4), (2, 1, 40, 2, 41, 1), (3, 0, 7, 1, 7, 1))
    SELECT diff_id, 0 AS file_no, hunk_no, old_start, old_lines, new_start, new_lines,
    CASE WHEN form = 2 AND hunk_no = 0 THEN 'order ' || diff_id ELSE '' END AS header FROM o JOIN shape USING (form)""",
)
def _(spark, sf):
    return diff_hunks(V.order_diffs(spark, sf), ["diff_id"], "diff_text")


@query("s4_diff_lines", f"WITH {V.ORDER_LINES} SELECT * FROM lines")
def _(spark, sf):
    return diff_lines(V.order_diffs(spark, sf), ["diff_id"], "diff_text")


@query(
    "w1_section_numbers",
    f"""WITH {V.ORDER_LINES} SELECT diff_id, max(file_no) AS last_file, max(hunk_no) AS last_hunk, max(line_no) AS last_line,
    max(old_line) AS last_old, max(new_line) AS last_new FROM lines GROUP BY 1""",
)
def _(spark, sf):
    lines = diff_lines(V.order_diffs(spark, sf), ["diff_id"], "diff_text")
    return lines.groupBy("diff_id").agg(
        F.max("file_no").alias("last_file"),
        F.max("hunk_no").alias("last_hunk"),
        F.max("line_no").alias("last_line"),
        F.max("old_line").alias("last_old"),
        F.max("new_line").alias("last_new"),
    )


@query(
    "a7_hunk_counts",
    f"""WITH {V.ORDER_LINES} SELECT diff_id, file_no, hunk_no, count(*) FILTER (type <> 'insert') AS old_lines, count(*) FILTER (type <> 'delete') AS new_lines,
    count(*) FILTER (type = 'insert') AS inserted, count(*) FILTER (type = 'delete') AS deleted FROM lines GROUP BY ALL""",
)
def _(spark, sf):
    return hunk_counts(diff_lines(V.order_diffs(spark, sf), ["diff_id"], "diff_text"), ["diff_id"])


@query(
    "a7_file_counts",
    f"""WITH {V.ORDER_LINES} SELECT diff_id, file_no, count(*) FILTER (type = 'insert') AS inserted, count(*) FILTER (type = 'delete') AS deleted,
    max(hunk_no) + 1 AS hunks FROM lines GROUP BY ALL""",
)
def _(spark, sf):
    return file_counts(diff_lines(V.order_diffs(spark, sf), ["diff_id"], "diff_text"), ["diff_id"])
