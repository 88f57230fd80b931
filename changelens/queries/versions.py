"""Versions of the given tables: what the queries compare. Every row and the whole text take part.

Each construction is written twice, as a DataFrame and as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rows import dealt_out
from .registry import table

BASE, HEAD = "base", "head"

# --- documents: two snapshots; the last digit of the id says how a document was edited ------------------


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        "text",
        F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), "doc_id", F.lit(".txt")).alias("path"),
        (F.col("doc_id") % 10).alias("edit"),
    )


def base_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything but the documents added later."""
    return documents(spark, sf_dir).where("edit <> 1").select("path", F.col("text").alias("content"))


def head_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything but the deleted documents; some moved, some edited."""
    edit, text = F.col("edit"), F.col("text")
    return (
        documents(spark, sf_dir)
        .where("edit <> 0")
        .select(
            F.when(edit == 2, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")).alias("path"),
            F.when(edit == 3, F.concat(text, F.lit("\nappended line")))
            .when(edit == 4, F.concat(text, F.lit('\ntoken = "t'), "doc_id", F.lit('"')))
            .when(edit == 5, F.regexp_replace(text, r"\A[^\n]*\n?", ""))
            .when(edit == 6, F.replace(text, F.lit("@mail"), F.lit("@post")))
            .otherwise(text)
            .alias("content"),
        )
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        base_snapshot(spark, sf_dir).select(F.lit(BASE).alias("ref"), "path", "content")
        .unionByName(head_snapshot(spark, sf_dir).select(F.lit(HEAD).alias("ref"), "path", "content"))
    )


DOCS = """
docs AS (SELECT doc_id, text, source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, doc_id % 10 AS edit FROM documents),
base AS (SELECT path, text AS content FROM docs WHERE edit <> 1),
head AS (SELECT CASE WHEN edit = 2 THEN 'moved/' || path ELSE path END AS path,
  CASE edit WHEN 3 THEN text || chr(10) || 'appended line'
            WHEN 4 THEN text || chr(10) || 'token = "t' || doc_id || '"'
            WHEN 5 THEN CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END
            WHEN 6 THEN replace(text, '@mail', '@post')
            ELSE text END AS content
  FROM docs WHERE edit <> 0),
status AS (SELECT coalesce(b.path, h.path) AS path, sha256(b.content) AS old_hash, sha256(h.content) AS new_hash,
  b.content AS old_content, h.content AS new_content,
  CASE WHEN b.path IS NULL THEN 'add' WHEN h.path IS NULL THEN 'delete'
       WHEN b.content = h.content THEN 'same' ELSE 'modify' END AS type
  FROM base b FULL JOIN head h ON b.path = h.path)"""

# --- conversations: a turn is the next version of its conversation -------------------------------------

TURNS = """
turns AS (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS old_content, text AS new_content,
  lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)"""

# --- orders: one diff text per order; the last digits of the key choose its form -----------------------


def order_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    path = F.concat(F.lit("orders/"), "o_orderpriority", F.lit("/"), key, F.lit(".txt"))
    # As names with other than ASCII letters are written: quoted, with their bytes as octal numbers.
    accented = F.concat(F.lit("orders/"), "o_orderpriority", F.lit("/"), key, F.lit("\\303\\251.txt"))
    header = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n"))
    old = F.concat(F.lit("status "), "o_orderstatus")
    price = F.concat(F.lit("total "), F.col("o_totalprice").cast("decimal(18,2)"))
    added = F.concat(
        header, F.lit("new file mode 100644\nindex 0000000..abc1234\n--- /dev/null\n+++ b/"), path,
        F.lit("\n@@ -0,0 +1,2 @@\n+"), old, F.lit("\n+"), price, F.lit("\n"),
    )
    deleted = F.concat(
        F.lit('diff --git "a/'), accented, F.lit('" "b/'), accented, F.lit('"\ndeleted file mode 100644\nindex abc1234..0000000\n--- "a/'), accented,
        F.lit('"\n+++ /dev/null\n@@ -1 +0,0 @@\n-'), old, F.lit("\n\\ No newline at end of file\n"),
    )
    modified = F.concat(
        header, F.lit("index abc1234..def5678 100644\n--- a/"), path, F.lit("\n+++ b/"), path,
        F.lit("\n@@ -10,3 +10,4 @@ order "), key, F.lit("\n "), price, F.lit("\n-"), old,
        F.lit("\n+status DONE\n+closed\n end\n@@ -40,2 +41 @@\n-gone\n last\n-- \n2.40.1\n"),
    )
    renamed = F.concat(
        F.lit("diff --git a/"), path, F.lit(" b/done/"), path, F.lit("\nsimilarity index 95%\nrename from "), path,
        F.lit("\nrename to done/"), path, F.lit("\nindex abc1234..def5678 100755\n--- a/"), path, F.lit("\n+++ b/done/"), path,
        F.lit("\n@@ -7 +7 @@\n-"), old, F.lit("\n+status X\n"),
        F.lit("diff --git a/logo.png b/logo.png\nindex 1111111..2222222 100644\nBinary files a/logo.png and b/logo.png differ\n"),
    )
    form = key % 5
    text = F.when(form == 0, added).when(form == 1, deleted).when(form == 2, modified).when(form == 3, renamed).otherwise(F.lit(" \n\t\n"))
    return table(spark, sf_dir, "orders").select(key.alias("diff_id"), text.alias("diff_text"))


ORDERS = """
o AS (SELECT o_orderkey AS diff_id, o_orderkey % 5 AS form, 'orders/' || o_orderpriority || '/' || o_orderkey || CASE WHEN o_orderkey % 5 = 1 THEN 'é' ELSE '' END || '.txt' AS path,
  'status ' || o_orderstatus AS old, 'total ' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS price FROM orders)"""

# The lines of those texts, straight from the columns: form, file, hunk, line, type, content, old and new number.
ORDER_LINES = ORDERS + """,
shape(form, file_no, hunk_no, line_no, type, what, old_line, new_line) AS (VALUES
  (0, 0, 0, 0, 'insert', 'old', NULL, 1), (0, 0, 0, 1, 'insert', 'price', NULL, 2),
  (1, 0, 0, 0, 'delete', 'old', 1, NULL),
  (2, 0, 0, 0, 'normal', 'price', 10, 10), (2, 0, 0, 1, 'delete', 'old', 11, NULL), (2, 0, 0, 2, 'insert', 'status DONE', NULL, 11),
  (2, 0, 0, 3, 'insert', 'closed', NULL, 12), (2, 0, 0, 4, 'normal', 'end', 12, 13),
  (2, 0, 1, 0, 'delete', 'gone', 40, NULL), (2, 0, 1, 1, 'normal', 'last', 41, 41),
  (3, 0, 0, 0, 'delete', 'old', 7, NULL), (3, 0, 0, 1, 'insert', 'status X', NULL, 7)),
lines AS (SELECT diff_id, file_no, hunk_no, line_no, type,
  CASE what WHEN 'old' THEN old WHEN 'price' THEN price ELSE what END AS content, old_line, new_line
  FROM o JOIN shape USING (form))"""

# --- parts: JSON, XML and code texts -------------------------------------------------------------------


def part_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package-like document per part; keys are not in order, one value is nested."""
    text = F.concat(
        F.lit('{"version": "1.'), "p_size", F.lit('", "name": "'), "p_name", F.lit('", "dependencies": {"'),
        F.lower("p_type"), F.lit('": "^'), "p_size", F.lit('", "alpha": "~'), F.col("p_partkey"),
        F.lit('", "worker": {"z": ['), "p_size", F.lit(', "x"], "a": true}}, "size": '), "p_size",
        F.lit(', "none": null, "price": '), F.col("p_retailprice").cast("decimal(18,2)"), F.lit("}"),
    )
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size", text.alias("doc"))


PART_JSON = """
p AS (SELECT *, lower(p_type) AS dep, CAST(p_retailprice AS DECIMAL(18,2)) AS price FROM part)"""


def part_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project file per part; the key's last digit breaks some of them in different ways."""
    body = F.concat(
        F.lit('<project xmlns="http://x.org/4"><name>'), "p_name", F.lit("</name><size>"), "p_size",
        F.lit('</size><m:deps xmlns:m="http://x.org/m"><dep kind="a"><version>'), "p_size", F.lit(".1</version></dep>"),
        F.lit('<dep kind="b"><version>'), "p_partkey", F.lit(".2</version></dep><m:v>"), "p_brand", F.lit("</m:v></m:deps></project>"),
    )
    form = F.col("p_partkey") % 10
    text = (
        F.when(form == 0, F.concat(F.lit("<project><name>"), "p_name"))
        .when(form == 1, F.col("p_name"))
        .when(form == 2, F.concat(body, F.lit("<second/>")))
        .when(form == 3, F.concat(body, F.lit(" trailing")))
        .when(form == 4, F.lit(""))
        .when(form == 5, F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<!-- c -->\n'), body, F.lit("\n")))
        .otherwise(body)
    )
    return dealt_out(table(spark, sf_dir, "part")).select("p_partkey", text.alias("doc"))


PART_XML = """
p AS (SELECT *, p_partkey % 10 >= 5 AS sound FROM part)"""


def part_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source file per part; the key's last digits choose the language."""
    word, other = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    key = F.col("p_partkey").cast("string")
    files = {
        "ts": F.concat(F.lit("export interface "), F.initcap(word), F.lit(" {\n  id: number\n}\n\nexport function "), word, key,
                       F.lit("(a: string) {\n  if (a) {\n    return 1\n  }\n}\n\nexport async function "), other, F.lit("() { return "), key, F.lit(" }\n")),
        "py": F.concat(F.lit("import os\n\n\ndef "), word, key, F.lit("(a):\n    return a\n\n\nclass "), F.initcap(other), F.lit(":\n    x = "), key, F.lit("\n")),
        "go": F.concat(F.lit("package p\n\ntype "), F.initcap(word), F.lit(" struct {\n\tID int\n}\n\nfunc "), word, key, F.lit("(a int) int {\n\treturn a\n}\n")),
        "rs": F.concat(F.lit("pub struct "), F.initcap(word), F.lit(" {\n    id: u32,\n}\n\npub fn "), word, key, F.lit("(a: u32) -> u32 {\n    a\n}\n")),
        "JAVA": F.concat(F.lit("public class "), F.initcap(word), F.lit(" {\n    int id;\n}\n")),
    }
    form = F.col("p_partkey") % 5
    path, text = F.lit(""), F.lit("")
    for i, (ext, body) in enumerate(files.items()):
        path = F.when(form == i, F.concat(F.lit("src/part_"), key, F.lit(f".{ext}"))).otherwise(path)
        text = F.when(form == i, body).otherwise(text)
    return dealt_out(table(spark, sf_dir, "part")).select("p_partkey", path.alias("path"), text.alias("code"))


PART_CODE = """
p AS (SELECT p_partkey, p_partkey % 5 AS form, string_split(p_name, ' ')[1] AS word, string_split(p_name, ' ')[-1] AS other,
  upper(left(p_name, 1)) || substr(string_split(p_name, ' ')[1], 2) AS title,
  upper(left(string_split(p_name, ' ')[-1], 1)) || substr(string_split(p_name, ' ')[-1], 2) AS other_title FROM part)"""

# --- events as spans: the match is the user, the start the second, the length the value ----------------


def event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.timestamp_diff("SECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("match_id"), "event_id", "event_type", start.alias("start"), (start + F.floor(F.abs("value") * 1000).cast("bigint")).alias("end")
    )


SPANS = """
spans AS (SELECT user_id AS match_id, event_id, event_type, s AS "start", s + CAST(floor(abs(value) * 1000) AS BIGINT) AS "end"
  FROM (SELECT *, CAST(epoch(date_trunc('second', ts)) AS BIGINT) - CAST(epoch(TIMESTAMP '2024-01-01 00:00:00') AS BIGINT) AS s FROM events))"""

# --- lines of a text in SQL ----------------------------------------------------------------------------


def sql_lines(text: str) -> str:
    parts = f"string_split({text}, chr(10))"
    return (
        f"CASE WHEN {text} = '' THEN CAST([] AS VARCHAR[]) "
        f"WHEN ends_with({text}, chr(10)) THEN {parts}[:len({parts}) - 1] "
        f"ELSE list_concat({parts}[:len({parts}) - 1], [{parts}[-1] || chr(10) || '\\ No newline at end of file']) END"
    )


def sql_hunks(source: str) -> str:
    """CTEs ``edges`` and ``hunks`` over a CTE with lists ``l`` and ``r``: bounds and unified text."""
    return f"""
edges0 AS (SELECT *, least(len(l), len(r)) AS m FROM {source}),
edges1 AS (SELECT *, coalesce(nullif(list_position(list_transform(range(1, m + 1), lambda i: l[i] = r[i]), false), 0) - 1, m) AS pre FROM edges0),
edges AS (SELECT *, coalesce(nullif(list_position(list_transform(range(0, m - pre), lambda i: l[len(l) - i] = r[len(r) - i]), false), 0) - 1, m - pre) AS suf FROM edges1),
bounds AS (SELECT *, least(pre, 3) AS b4, least(suf, 3) AS aft,
  len(l) - pre - suf + least(pre, 3) + least(suf, 3) AS old_lines, len(r) - pre - suf + least(pre, 3) + least(suf, 3) AS new_lines FROM edges),
hunk0 AS (SELECT * REPLACE (CAST(old_lines AS INTEGER) AS old_lines, CAST(new_lines AS INTEGER) AS new_lines),
  CAST(CASE WHEN old_lines = 0 THEN 0 ELSE pre - b4 + 1 END AS INTEGER) AS old_start,
  CAST(CASE WHEN new_lines = 0 THEN 0 ELSE pre - b4 + 1 END AS INTEGER) AS new_start FROM bounds),
hunks AS (SELECT *, '@@ -' || old_start || CASE WHEN old_lines = 1 THEN '' ELSE ',' || old_lines END
  || ' +' || new_start || CASE WHEN new_lines = 1 THEN '' ELSE ',' || new_lines END || ' @@' || chr(10)
  || array_to_string(list_concat(
       list_transform(l[pre - b4 + 1 : pre], lambda x: ' ' || x),
       list_transform(l[pre + 1 : len(l) - suf], lambda x: '-' || x),
       list_transform(r[pre + 1 : len(r) - suf], lambda x: '+' || x),
       list_transform(l[len(l) - suf + 1 : len(l) - suf + aft], lambda x: ' ' || x)), chr(10)) || chr(10) AS diff_text FROM hunk0)"""
