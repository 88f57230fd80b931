"""Watches, rendering, reports, sinks and extension points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.artifacts import artifact, or_empty
from ..functions.regex import regex_extract
from ..functions.template import html_escape, render, render_rows
from ..operators.snapshots import attach_versions, snapshot_diff
from ..plans import reports as R
from ..plans.extractors import register_extractor
from ..plans.reports import (
    Rule,
    apply_watches,
    collect_reports,
    notifications,
    order_reports,
    report_metadata,
    run_rules,
)
from ..sources.patches import diff_files
from ..sources.sinks import reports_json, reports_text
from . import versions as V
from .extraction import EMAIL, TOKEN, TOKEN_RX, sql_matches, sql_token_context
from .joins import DECLARED, _declared
from .registry import query, table

RULES = [
    Rule("privacy", 0, 0, ("src*/**",), "regex", {"pattern": EMAIL}, "E-mail changed in {{filePath}}:\n{{diffText}}",
         notify={"github": "@privacy", "slack": "#pii"}),
    Rule("privacy", 0, 1, ("**/en/**", "**/de/*"), "regex", {"pattern": TOKEN}, "{{left.artifact}} -> {{ right.artifact }}{{unknown}}"),
    Rule("growth", 1, 0, ("**/*.txt",), "regex", {"pattern": "^appended .*$", "flags": "i"}, "{{filePath}} grew",
         notify={"email": "growth@example.org"}),
]

# The same reports in SQL: artifacts of every rule, those that differ, their hunk, the message.
REPORTS = V.DOCS + f""",
sides AS (SELECT path, coalesce(old_content, '') AS a, coalesce(new_content, '') AS b FROM status WHERE type <> 'same'),
fired0 AS (
  SELECT path, 0 AS rule_no, {sql_matches('a', EMAIL)} AS x, {sql_matches('b', EMAIL)} AS y,
    CASE WHEN len(regexp_extract_all(a, '{EMAIL}')) > 0 THEN '[]' END AS cx, CASE WHEN len(regexp_extract_all(b, '{EMAIL}')) > 0 THEN '[]' END AS cy
  FROM sides WHERE regexp_matches(path, '^src[^/]*/')
  UNION ALL SELECT path, 1, {sql_matches('a', TOKEN_RX)}, {sql_matches('b', TOKEN_RX)}, {sql_token_context('a')}, {sql_token_context('b')}
  FROM sides WHERE regexp_matches(path, '(^|/)(en|de)/')
  UNION ALL SELECT path, 2, {sql_matches('a', '(?mi)^appended .*$')}, {sql_matches('b', '(?mi)^appended .*$')},
    CASE WHEN regexp_matches(a, '(?mi)^appended .*$') THEN '[]' END, CASE WHEN regexp_matches(b, '(?mi)^appended .*$') THEN '[]' END
  FROM sides),
fired AS (SELECT *, {V.sql_lines('x')} AS l, {V.sql_lines('y')} AS r FROM fired0 WHERE x <> y),
{V.sql_hunks('fired')},
reports AS (SELECT path, path AS file_name, CASE WHEN rule_no < 2 THEN 'privacy' ELSE 'growth' END AS concern_id,
  CASE WHEN rule_no < 2 THEN 0 ELSE 1 END AS concern_pos, CASE WHEN rule_no = 1 THEN 1 ELSE 0 END AS signal_pos,
  CASE rule_no WHEN 0 THEN 'E-mail changed in ' || path || ':' || chr(10) || diff_text WHEN 1 THEN x || ' -> ' || y ELSE path || ' grew' END AS message,
  diff_text, x AS left_artifact, y AS right_artifact, new_start AS line_start, new_start + new_lines - 1 AS line_end,
  '[' || CASE WHEN cx = cy OR cy IS NULL THEN cx WHEN cx IS NULL THEN cy ELSE cx || ',' || cy END || ']' AS context,
  CASE rule_no WHEN 0 THEN ['github', 'slack'] WHEN 2 THEN ['email'] END AS channels,
  CASE rule_no WHEN 0 THEN ['@privacy', '#pii'] WHEN 2 THEN ['growth@example.org'] END AS targets
  FROM hunks)"""


def document_changes(spark, sf):
    changes = snapshot_diff(V.base_snapshot(spark, sf), V.head_snapshot(spark, sf), ["path"], "content")
    return changes.select(
        "path",
        F.when(F.col("type") != "add", F.col("path")).alias("old_path"),
        F.when(F.col("type") != "delete", F.col("path")).alias("new_path"),
        "type",
    )


def document_reports(spark, sf, rules=RULES, hunks="one"):
    return run_rules(document_changes(spark, sf), V.snapshots(spark, sf), rules, ["path"], V.BASE, V.HEAD, hunks)


REPORT_COLUMNS = (
    "path, concern_id, concern_pos, signal_pos, file_name, message, diff_text, left_artifact, right_artifact, line_start, line_end, context"
)


@query("r5_run_rules", f"WITH {REPORTS} SELECT {REPORT_COLUMNS} FROM reports")
def _(spark, sf):
    return document_reports(spark, sf).drop("notify")


@query(
    "r5_anchored_net",
    f"""WITH {REPORTS} SELECT path, concern_id, signal_pos, left_artifact, right_artifact,
    CAST(len(regexp_extract_all(diff_text, '(?m)^[+]')) AS BIGINT) - len(regexp_extract_all(diff_text, '(?m)^-')) AS net FROM reports""",
)
def _(spark, sf):
    rows = document_reports(spark, sf, hunks="anchored")

    def lines(mark):
        return F.size(F.regexp_extract_all(F.col("diff_text"), F.lit(f"(?m)^{mark}"), F.lit(0)))

    return rows.select(
        "path", "concern_id", "signal_pos", "left_artifact", "right_artifact", (lines("[+]") - lines("-")).cast("bigint").alias("net")
    )


@query("o1_order_reports", f"WITH {REPORTS} SELECT path, concern_pos, signal_pos, concern_id FROM reports ORDER BY 1, 2, 3")
def _(spark, sf):
    return order_reports(document_reports(spark, sf), ["path"], ["concern_id"])


@query(
    "a6_collect_reports",
    f"""WITH {REPORTS} SELECT path, count(*) AS n, string_agg(message, '|' ORDER BY concern_pos, signal_pos) AS messages FROM reports GROUP BY 1""",
)
def _(spark, sf):
    rows = collect_reports(document_reports(spark, sf), ["path"])
    return rows.select(
        "path",
        F.size("reports").cast("bigint").alias("n"),
        F.array_join(F.transform("reports", lambda r: r["message"]), "|").alias("messages"),
    )


SQL_METADATA = """'{"diffText":' || CAST(to_json(diff_text) AS VARCHAR) || ',"fileName":"' || file_name || '","message":' || CAST(to_json(message) AS VARCHAR)
  || ',"lineRange":{"end":' || line_end || ',"start":' || line_start || '},"context":' || context || '}'"""


@query(
    "s7_reports_json",
    f"""WITH {REPORTS} SELECT path, '{{"reports":[' || string_agg({SQL_METADATA}, ',' ORDER BY concern_pos, signal_pos) || ']}}' AS json FROM reports GROUP BY 1""",
)
def _(spark, sf):
    return reports_json(document_reports(spark, sf), ["path"])


@query("s8_reports_text", f"WITH {REPORTS} SELECT path, concern_pos, signal_pos, message FROM reports")
def _(spark, sf):
    return reports_text(document_reports(spark, sf), ["path"])


@query("r3_report_metadata", f"WITH {REPORTS} SELECT path, signal_pos, concern_id, {SQL_METADATA} AS metadata FROM reports")
def _(spark, sf):
    rows = document_reports(spark, sf)
    return rows.select("path", "signal_pos", "concern_id", F.to_json(report_metadata()).alias("metadata"))


@query(
    "r4_notifications",
    f"""WITH {REPORTS} SELECT path, concern_pos, signal_pos, file_name, message, channels[i] AS channel, targets[i] AS target
    FROM (SELECT *, unnest(range(1, len(channels) + 1)) AS i FROM reports)""",
)
def _(spark, sf):
    return notifications(document_reports(spark, sf), ["path"])


@query(
    "u1_union_reports",
    f"""WITH {REPORTS} SELECT path, concern, message FROM reports CROSS JOIN (VALUES ('first'), ('second')) v(concern) WHERE concern_id = 'growth'""",
)
def _(spark, sf):
    # Two concerns with the same signal: both report, nothing is merged.
    twice = [
        Rule(name, i, 0, RULES[2].include, "regex", RULES[2].params, RULES[2].template) for i, name in enumerate(["first", "second"])
    ]
    return document_reports(spark, sf, twice).select("path", F.col("concern_id").alias("concern"), "message")


@query(
    "p5_or_empty",
    f"""WITH {V.DOCS}, {DECLARED} SELECT doc_id, {sql_matches("coalesce(old_content, '')", '[A-Z][a-z]+[.]')} AS old_artifact,
    {sql_matches("coalesce(new_content, '')", '[A-Z][a-z]+[.]')} AS new_artifact FROM attached""",
)
def _(spark, sf):
    rows = attach_versions(_declared(spark, sf), V.snapshots(spark, sf), V.BASE, V.HEAD)
    return rows.select(
        "doc_id",
        regex_extract(F.col("old_content"), "[A-Z][a-z]+[.]")["text"].alias("old_artifact"),
        regex_extract(F.col("new_content"), "[A-Z][a-z]+[.]")["text"].alias("new_artifact"),
    )


@query(
    "p6_changed",
    f"""WITH {V.DOCS}, {DECLARED}, arts AS (SELECT doc_id, path, {sql_matches("coalesce(old_content, '')", EMAIL)} AS l, {sql_matches("coalesce(new_content, '')", EMAIL)} AS r
    FROM attached) SELECT doc_id, l AS left_artifact, r AS right_artifact FROM arts WHERE l <> r""",
)
def _(spark, sf):
    rows = attach_versions(_declared(spark, sf), V.snapshots(spark, sf), V.BASE, V.HEAD)
    rule = Rule("any", 0, 0, ("**",), "regex", {"pattern": EMAIL})
    return apply_watches(rows, [rule], ["doc_id"]).select("doc_id", "left_artifact", "right_artifact")


# --- one document of every kind per part, to run all extractors -----------------------------------------

MIXED_RULES = [
    Rule("data", 0, 0, ("**/*.json",), "jq", {"query": ".size"}, "{{diffText}}"),
    Rule("data", 0, 1, ("**/*.json",), "jq", {"query": ".deps"}, "{{filePath}}"),
    Rule("data", 0, 2, ("**/*.json",), "jq", {"query": ".deps | keys"}, "never"),
    Rule("data", 0, 3, ("part/*.xml",), "xpath", {"expression": "string(//size)"}, "{{right.artifact}}"),
    Rule("data", 0, 4, ("part/*.xml",), "xpath", {"expression": "//p:size", "namespaces": '{"p": "http://x.org/4"}'}, "{{right.artifact}}"),
    Rule("code", 1, 0, ("**/*.py",), "tsq", {"kind": "function", "capture": "name"}, "{{right.artifact}}"),
    Rule("code", 1, 1, ("**/*.log",), "ast-grep", {"language": "javascript", "pattern": "open($NAME, $$$ARGS)"}, "{{right.artifact}}"),
    Rule("code", 1, 2, ("**/*.{env,ini}",), "regex", {"pattern": r"^SIZE=(?<size>\d+)$"}, "{{right.artifact}}"),
]


def mixed_documents(spark, sf):
    """Changes and snapshots of five small documents per part; the size of odd parts grows by one."""
    parts = table(spark, sf, "part")
    name, key = F.col("p_name"), F.col("p_partkey")

    def texts(size):
        return F.map_from_arrays(
            F.array(*[F.concat(F.lit("part/"), key, F.lit(f".{ext}")) for ext in ("json", "xml", "py", "log", "env")]),
            F.array(
                F.concat(F.lit('{"name": "'), name, F.lit('", "size": '), size, F.lit(', "deps": {"b": "~'), size, F.lit('", "a": [1,'), size, F.lit("]}}")),
                F.concat(F.lit('<project xmlns="http://x.org/4"><name>'), name, F.lit("</name><size>"), size, F.lit("</size></project>")),
                F.concat(F.lit("def f"), size, F.lit("():\n    return 1\n\n\ndef g():\n    return 2\n")),
                F.concat(F.lit("open(alpha, "), size, F.lit(", (1));\nclose(beta)\nopen( x , y )\n")),
                F.concat(F.lit("SIZE="), size, F.lit("\nNAME="), name, F.lit("\n")),
            ),
        )

    size = F.col("p_size").cast("string")
    grown = (F.col("p_size") + key % 2).cast("string")
    base = parts.select(F.lit("old").alias("ref"), F.explode(texts(size)).alias("path", "content"))
    head = parts.select(F.lit("new").alias("ref"), F.explode(texts(grown)).alias("path", "content"))
    changes = base.select("path", F.col("path").alias("old_path"), F.col("path").alias("new_path"), F.lit("modify").alias("type"))
    return changes, base.unionByName(head)


MIXED = """
p AS (SELECT p_partkey, CAST(p_size AS VARCHAR) AS a, CAST(p_size + 1 AS VARCHAR) AS b, p_name FROM part WHERE p_partkey % 2 = 1),
arts(path, rule_no, l, r, context) AS (
  SELECT 'part/' || p_partkey || '.json', 0, a || chr(10), b || chr(10), NULL FROM p
  UNION ALL SELECT 'part/' || p_partkey || '.json', 1, '{' || chr(10) || '  "b": "~' || a || '",' || chr(10) || '  "a": [1,' || a || ']' || chr(10) || '}' || chr(10),
    '{' || chr(10) || '  "b": "~' || b || '",' || chr(10) || '  "a": [1,' || b || ']' || chr(10) || '}' || chr(10), NULL FROM p
  UNION ALL SELECT 'part/' || p_partkey || '.xml', 3, a, b, NULL FROM p
  UNION ALL SELECT 'part/' || p_partkey || '.xml', 4, a, b, NULL FROM p
  UNION ALL SELECT 'part/' || p_partkey || '.py', 5, 'f' || a || chr(10) || chr(10) || 'g', 'f' || b || chr(10) || chr(10) || 'g', '[[]]' FROM p
  UNION ALL SELECT 'part/' || p_partkey || '.log', 6, 'open(alpha, ' || a || ', (1))' || chr(10) || chr(10) || 'open( x , y )',
    'open(alpha, ' || b || ', (1))' || chr(10) || chr(10) || 'open( x , y )',
    '[[{"NAME":"alpha","ARGS":"' || a || ', (1)"},{"NAME":"x","ARGS":"y "}],[{"NAME":"alpha","ARGS":"' || b || ', (1)"},{"NAME":"x","ARGS":"y "}]]' FROM p
  UNION ALL SELECT 'part/' || p_partkey || '.env', 7, 'SIZE=' || a, 'SIZE=' || b, '[[{"size":"' || a || '"}],[{"size":"' || b || '"}]]' FROM p)"""


@query(
    "p8_apply_watches",
    f"WITH {MIXED} SELECT path, path AS file_path, rule_no, l AS left_artifact, r AS right_artifact, context FROM arts",
)
def _(spark, sf):
    changes, snapshots = mixed_documents(spark, sf)
    versions = attach_versions(changes, snapshots, "old", "new")
    return apply_watches(versions, MIXED_RULES, ["path"])


@query(
    "r5_all_watches",
    f"""WITH {MIXED}, texts AS (SELECT *, {V.sql_lines('arts.l')} AS ll, {V.sql_lines('arts.r')} AS rr FROM arts),
    src AS (SELECT path, rule_no, l AS x, r AS y, ll AS l, rr AS r FROM texts), {V.sql_hunks('src')}
    SELECT path, CASE WHEN rule_no < 5 THEN 'data' ELSE 'code' END AS concern_id, CASE WHEN rule_no < 5 THEN rule_no ELSE rule_no - 5 END AS signal_pos,
    CASE rule_no WHEN 0 THEN diff_text WHEN 1 THEN path ELSE y END AS message, diff_text,
    CASE WHEN rule_no > 1 THEN new_start END AS line_start, CASE WHEN rule_no > 1 THEN new_start + new_lines - 1 END AS line_end FROM hunks""",
)
def _(spark, sf):
    changes, snapshots = mixed_documents(spark, sf)
    rows = run_rules(changes, snapshots, MIXED_RULES, ["path"], "old", "new")
    return rows.select("path", "concern_id", "signal_pos", "message", "diff_text", "line_start", "line_end")


# --- stored diffs: files from diff texts, contents by the refs of each diff ---------------------------------

DIFF_RULES = [
    Rule("orders", 0, 0, ("orders/**", "done/**"), "regex", {"pattern": "^status (?<status>.*)$"}, "{{filePath}}: {{right.artifact}}"),
    Rule("logo", 1, 0, ("*.png",), "regex", {"pattern": "."}, "never"),
]


def _order_files(spark, sf):
    """Contents before and after each stored diff; the ref names the diff."""
    key, form = F.col("o_orderkey"), F.col("o_orderkey") % 5
    path = F.concat(F.lit("orders/"), "o_orderpriority", F.lit("/"), key, F.when(form == 1, "é.txt").otherwise(".txt"))
    orders = table(spark, sf, "orders")
    text = F.concat(F.lit("id "), key, F.lit("\nstatus "), "o_orderstatus", F.lit("\n"))
    base = orders.where(form != 0).select(F.concat(F.lit("b"), key).alias("ref"), path.alias("path"), text.alias("content"))
    moved = F.when(form == 3, F.concat(F.lit("done/"), path)).otherwise(path)
    done = F.concat(F.lit("id "), key, F.lit("\nstatus DONE\n"))
    head = orders.where(form != 1).select(F.concat(F.lit("h"), key).alias("ref"), moved.alias("path"), done.alias("content"))
    return base.unionByName(head)


@query(
    "r5_stored_diffs",
    f"""WITH {V.ORDERS} SELECT diff_id, CASE form WHEN 3 THEN 'done/' || path ELSE path END AS file_name,
    CASE form WHEN 3 THEN 'done/' || path ELSE path END || ': ' || CASE WHEN form = 1 THEN '' ELSE 'status DONE' END AS message,
    '@@ -' || CASE WHEN form = 0 THEN '0,0' ELSE '1' END || ' +' || CASE WHEN form = 1 THEN '0,0' ELSE '1' END || ' @@' || chr(10)
      || CASE WHEN form = 0 THEN '' ELSE '-' || old || chr(10) || '\\ No newline at end of file' || chr(10) END
      || CASE WHEN form = 1 THEN '' ELSE '+status DONE' || chr(10) || '\\ No newline at end of file' || chr(10) END AS diff_text,
    CAST(CASE WHEN form = 1 THEN 0 ELSE 1 END AS INTEGER) AS line_start, CAST(CASE WHEN form = 1 THEN -1 ELSE 1 END AS INTEGER) AS line_end
    FROM o WHERE form < 4""",
)
def _(spark, sf):
    files = diff_files(V.order_diffs(spark, sf), ["diff_id"], "diff_text")
    base, head = F.concat(F.lit("b"), "diff_id"), F.concat(F.lit("h"), "diff_id")
    rows = run_rules(files, _order_files(spark, sf), DIFF_RULES, ["diff_id", "file_no"], base, head)
    return rows.select("diff_id", "file_name", "message", "diff_text", "line_start", "line_end")


# --- templates ------------------------------------------------------------------------------------------


@query(
    "r1_render",
    """SELECT doc_id, 'Changed ' || source || '&lt;' || lang || '&gt;: ' || text || '|' || '|' || text || '{{lang}}' AS fixed,
    lang || ' <' || source || '> ' || text || ' by' AS per_row FROM documents""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents")
    values = {
        "filePath": F.concat("source", F.lit("<"), "lang", F.lit(">")),
        "diffText": F.col("text"),
        "left.artifact": F.concat("text", F.lit("{{lang}}")),
    }
    per_row = F.concat(F.lit("{{a}} <"), "source", F.lit("> {{ b.c }} by{{unknown}}"))
    named = F.create_map(F.lit("a"), F.col("lang"), F.lit("b.c"), F.col("text"))
    return docs.select(
        "doc_id",
        render("Changed {{filePath}}: {{diffText}}|{{missing}}|{{{left.artifact}}}", values).alias("fixed"),
        render_rows(per_row, named).alias("per_row"),
    )


# --- extension points -----------------------------------------------------------------------------------


def _line_count(content, path, params):
    lines = F.size(F.split(content, "\n", -1)).cast("string")
    return or_empty(artifact(F.concat(F.lit(params["label"]), lines)), content)


@query(
    "d1_custom_extractor",
    f"""WITH {V.DOCS}, {DECLARED}, arts AS (SELECT doc_id, CASE WHEN coalesce(old_content, '') = '' THEN '' ELSE 'lines: ' || len(string_split(old_content, chr(10))) END AS l,
    CASE WHEN coalesce(new_content, '') = '' THEN '' ELSE 'lines: ' || len(string_split(new_content, chr(10))) END AS r FROM attached)
    SELECT doc_id, l AS left_artifact, r AS right_artifact FROM arts WHERE l <> r""",
)
def _(spark, sf):
    register_extractor("line-count", _line_count)
    rows = attach_versions(_declared(spark, sf), V.snapshots(spark, sf), V.BASE, V.HEAD)
    rule = Rule("size", 0, 0, ("**",), "line-count", {"label": "lines: "})
    return apply_watches(rows, [rule], ["doc_id"]).select("doc_id", "left_artifact", "right_artifact")


@query(
    "d2_content_provider",
    f"""WITH {V.TURNS}, arts AS (SELECT conv_id, turn, {sql_matches("old_content", '[A-Z][a-z]+')} AS l, {sql_matches("new_content", '[A-Z][a-z]+')} AS r
    FROM turns WHERE before IS NOT NULL) SELECT conv_id, turn, l AS left_artifact, r AS right_artifact FROM arts WHERE l <> r""",
)
def _(spark, sf):
    # The turns of a conversation are the provider: the turn number is the ref, the conversation the path.
    turns = table(spark, sf, "conversations")
    provider = turns.select(F.col("turn").cast("string").alias("ref"), F.concat(F.lit("conv/"), "conv_id").alias("path"), F.col("text").alias("content"))
    changes = turns.where("turn > 0").select(
        "conv_id",
        "turn",
        F.concat(F.lit("conv/"), "conv_id").alias("old_path"),
        F.concat(F.lit("conv/"), "conv_id").alias("new_path"),
        F.lit("modify").alias("type"),
    )
    rule = Rule("names", 0, 0, ("conv/*",), "regex", {"pattern": "[A-Z][a-z]+"})
    rows = run_rules(changes, provider, [rule], ["conv_id", "turn"], (F.col("turn") - 1).cast("string"), F.col("turn").cast("string"))
    return rows.select("conv_id", "turn", "left_artifact", "right_artifact")


def _upper_renderer(template, values):
    return F.upper(F.concat(F.lit(template), html_escape(values["filePath"])))


@query("d3_report_type", f"WITH {REPORTS} SELECT path, upper('Grew: ' || path) AS message FROM reports WHERE concern_id = 'growth'")
def _(spark, sf):
    R.RENDERERS["upper"] = _upper_renderer
    rule = Rule("growth", 0, 0, RULES[2].include, "regex", RULES[2].params, "grew: ", report_type="upper")
    return document_reports(spark, sf, [rule]).select("path", "message")
