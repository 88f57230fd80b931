"""Text, JSON, XML and code extraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.artifacts import join_matches, merge_context, merge_maps
from ..functions.code import code_extract, declarations, template_extract, template_extracts
from ..functions.jsonx import (
    json_all_keys,
    json_compact,
    json_del,
    json_entries,
    json_extract,
    json_keys,
    json_object,
    json_path,
    json_pretty,
    json_strings,
    last_values,
)
from ..functions.refs import parse_pr_url, parse_remote, parse_tracking
from ..functions.regex import regex_extract
from ..functions.template import html_escape
from ..functions.xmlx import element_markup, well_formed, xml_extract, xpath_nodes, xpath_value
from ..operators.jsondiff import json_entry_diff, json_nodes
from ..operators.ordered import with_previous
from ..operators.rows import dealt_out
from ..sources.snapshots import snapshots_from
from . import versions as V
from .registry import query, table

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"
TOKEN = r'(?<secret_kind>token|secret|api_key|password)\s*=\s*"(?<value>[^"\n]*)"'
# The groups of TOKEN in SQL, as the JSON list of maps that is the context of one side.
TOKEN_RX = r'(token|secret|api_key|password)\s*=\s*"([^"\n]*)"'


def sql_matches(text: str, rx: str, sep: str = "chr(10)") -> str:
    rx = rx.replace("'", "''")
    return f"coalesce(array_to_string(regexp_extract_all({text}, '{rx}'), {sep}), '')"


def sql_token_context(text: str) -> str:
    return (
        f"CASE WHEN len(regexp_extract_all({text}, '{TOKEN_RX}')) > 0 THEN '[' || array_to_string(list_transform(list_zip("
        f"regexp_extract_all({text}, '{TOKEN_RX}', 1), regexp_extract_all({text}, '{TOKEN_RX}', 2)), "
        "lambda x: '{\"secret_kind\":\"' || x[1] || '\"' || ',\"value\":' || CAST(to_json(x[2]) AS VARCHAR) || '}'), ',') || ']' END"
    )


@query("e1_regex_extract", f"SELECT doc_id, {sql_matches('text', EMAIL)} AS artifact FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", regex_extract(F.col("text"), EMAIL)["text"].alias("artifact"))


@query(
    "e2_named_groups",
    f"SELECT doc_id, {sql_matches('text', TOKEN_RX)} AS artifact, {sql_token_context('text')} AS context FROM documents",
)
def _(spark, sf):
    found = regex_extract(F.col("text"), TOKEN)
    return table(spark, sf, "documents").select(
        "doc_id", found["text"].alias("artifact"), F.try_element_at(found["context"], F.lit(1)).alias("context")
    )


@query(
    "e3_flags",
    f"""SELECT doc_id, {sql_matches('text', '(?m)^The [a-z]+')} AS lines, {sql_matches('text', '^The [a-z]+')} AS start_only,
    {sql_matches('text', '(?mi)^éle[a-zè]*')} AS folded, {sql_matches('text', '(?ms)^It.*the')} AS spanning FROM documents""",
)
def _(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        regex_extract(text, "^The [a-z]+")["text"].alias("lines"),
        regex_extract(text, "^The [a-z]+", "g")["text"].alias("start_only"),
        regex_extract(text, "^éle[a-zè]*", "i")["text"].alias("folded"),
        regex_extract(text, "^It.*the", "s")["text"].alias("spanning"),
    )


@query(
    "a1_join_matches",
    f"SELECT doc_id, {sql_matches('text', '[A-Z][a-z]+[.]')} AS by_line, {sql_matches('text', '[A-Z][a-z]+[.]', 'chr(10) || chr(10)')} AS by_block FROM documents",
)
def _(spark, sf):
    found = F.regexp_extract_all(F.col("text"), F.lit("[A-Z][a-z]+[.]"), F.lit(0))
    return table(spark, sf, "documents").select(
        "doc_id", join_matches(found).alias("by_line"), join_matches(found, "\n\n").alias("by_block")
    )


@query(
    "a3_merge_context",
    """SELECT event_id, CASE WHEN event_type = 'view' THEN '["' || user_id % 3 || '"]' WHEN user_id % 3 = 1 THEN '[["x"]]'
    ELSE '["' || user_id % 3 || '",["x"]]' END AS context FROM (SELECT * FROM events WHERE event_type = 'view' OR user_id % 3 <> 1)
    UNION ALL SELECT event_id, '[["x"]]' FROM events WHERE event_type <> 'view' AND user_id % 3 = 1""",
)
def _(spark, sf):
    # The left side holds one item (the same as the right one for some users); views have no right side.
    left = F.array(F.when(F.col("user_id") % 3 == 1, F.when(F.col("event_type") == "view", '"1"').otherwise('["x"]')).otherwise(
        F.concat(F.lit('"'), F.col("user_id") % 3, F.lit('"'))))
    right = F.when(F.col("event_type") == "view", F.array().cast("array<string>")).otherwise(F.array(F.lit('["x"]')))
    return table(spark, sf, "events").select("event_id", merge_context(left, right).alias("context"))


@query(
    "a4_merge_maps",
    """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN 'A=' || p_brand || ';B=' || p_name
    WHEN p_size % 4 = 2 THEN 'B=' || p_type ELSE 'C=' || p_name || ';A=' || p_type || ';B=' || p_type END AS merged FROM part""",
)
def _(spark, sf):
    form = F.col("p_size") % 4
    none = F.create_map().cast("map<string,string>")

    def a_map(*items):
        return F.create_map(*[x if not isinstance(x, str) else F.lit(x) for x in items])

    brand, name, kind = F.col("p_brand"), F.col("p_name"), F.col("p_type")
    single = F.when(form == 1, a_map("A", brand, "B", name)).when(form == 3, a_map("A", brand, "C", name)).otherwise(none)
    multi = F.when(form == 2, a_map("B", name)).when(form == 3, a_map("A", kind, "B", name)).otherwise(none)
    transformed = F.when(form >= 2, a_map("B", kind)).otherwise(none)
    merged = merge_maps(single, multi, transformed)
    shown = F.array_join(F.transform(F.map_entries(merged), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return table(spark, sf, "part").select("p_partkey", shown.alias("merged"))


# --- JSON -----------------------------------------------------------------------------------------------


@query(
    "k1_json_path",
    f"""WITH {V.PART_JSON} SELECT p_partkey, '"' || p_name || '"' AS name, CAST(p_size AS VARCHAR) AS size, 'null' AS none, 'null' AS missing,
    '{{"z":[' || p_size || ',"x"],"a":true}}' AS worker, '"^' || p_size || '"' || chr(10) AS artifact FROM p""",
)
def _(spark, sf):
    doc = F.col("doc")
    return V.part_json(spark, sf).select(
        "p_partkey",
        json_path(doc, "$.name").alias("name"),
        json_path(doc, "$.size").alias("size"),
        json_path(doc, "$.none").alias("none"),
        json_path(doc, "$.missing").alias("missing"),
        json_path(doc, "$.dependencies.worker").alias("worker"),
        # One rule per key in use: the key is part of the query text.
        F.coalesce(*[
            F.when(F.lower("p_type") == t, json_extract(doc, f".dependencies.{t}")["text"])
            for t in ("economy", "small", "medium", "promo", "large", "standard")
        ]).alias("artifact"),
    )


@query(
    "k1_repeated_keys",
    """SELECT p_partkey, p_size::VARCHAR AS k, '[' || p_size || ',1.5]' AS x, '["k","n","o"]' AS keys,
    '{"k":' || p_size || ',"o":{"x":[' || p_size || ',1.5]}}' AS rest, '[' || chr(10) || '  "x"' || chr(10) || ']' || chr(10) AS inner_keys FROM part""",
)
def _(spark, sf):
    """Every document repeats keys, in itself and further in; the last value of each counts."""
    parts = [F.lit('{"k":1,"n":"'), F.col("p_name"), F.lit('","k":'), F.col("p_size"), F.lit(',"o":{"x":"'), F.col("p_brand"), F.lit('","x":['), F.col("p_size"), F.lit(",1.5]}}")]
    doc = F.col("doc")
    return table(spark, sf, "part").select("p_partkey", last_values(F.concat(*parts)).alias("doc")).select(
        "p_partkey",
        json_path(doc, "$.k").alias("k"),
        json_path(doc, "$.o.x").alias("x"),
        F.to_json(json_keys(doc)).alias("keys"),
        json_compact(json_del(doc, "$", "n")).alias("rest"),
        json_extract(doc, ".o | keys")["text"].alias("inner_keys"),
    )


@query("k1_json_props", """SELECT event_id, regexp_extract(props, '"k": ([0-9]+)', 1) AS k, 'null' || chr(10) AS missing FROM events""")
def _(spark, sf):
    props = F.col("props")
    return table(spark, sf, "events").select(
        "event_id", json_path(props, "$.k").alias("k"), json_extract(props, ".other")["text"].alias("missing")
    )


@query(
    "k2_json_keys",
    f"""WITH {V.PART_JSON} SELECT p_partkey, array_to_string(list_sort(['alpha', dep, 'worker']), ',') AS keys,
    '[' || chr(10) || array_to_string(list_transform(list_sort(['alpha', dep, 'worker']), lambda k: '  "' || k || '"'), ',' || chr(10))
    || chr(10) || ']' || chr(10) AS artifact FROM p""",
)
def _(spark, sf):
    doc = F.col("doc")
    return V.part_json(spark, sf).select(
        "p_partkey",
        F.array_join(json_keys(doc, "$.dependencies"), ",").alias("keys"),
        json_extract(doc, ".dependencies | keys")["text"].alias("artifact"),
    )


@query(
    "k3_json_del",
    f"""WITH {V.PART_JSON} SELECT p_partkey, '{{"' || dep || '":"^' || p_size || '","alpha":"~' || p_partkey || '"}}' AS rest,
    '{{' || chr(10) || '  "' || dep || '": "^' || p_size || '",' || chr(10) || '  "alpha": "~' || p_partkey || '"' || chr(10) || '}}' || chr(10) AS artifact FROM p""",
)
def _(spark, sf):
    doc = F.col("doc")
    return V.part_json(spark, sf).select(
        "p_partkey",
        json_compact(json_del(doc, "$.dependencies", "worker")).alias("rest"),
        json_extract(doc, ".dependencies | del(.worker)")["text"].alias("artifact"),
    )


@query(
    "k4_json_entries",
    f"""WITH {V.PART_JSON} SELECT p_partkey, '{{"name":"' || p_name || '","none":null}}' AS entries,
    '[' || chr(10) || '  {{' || chr(10) || '    "key": "size",' || chr(10) || '    "value": ' || p_size || chr(10) || '  }}' || chr(10) || ']' || chr(10) AS artifact FROM p""",
)
def _(spark, sf):
    doc = F.col("doc")
    return V.part_json(spark, sf).select(
        "p_partkey",
        json_compact(json_entries(doc, "$", "n")).alias("entries"),
        json_extract(doc, '. | to_entries | map(select(.key | startswith("s")))')["text"].alias("artifact"),
    )


@query(
    "k5_json_pretty",
    f"""WITH {V.PART_JSON} SELECT p_partkey, array_to_string(['{{', '  "version": "1.' || p_size || '",', '  "name": "' || p_name || '",',
    '  "dependencies": {{"' || dep || '":"^' || p_size || '","alpha":"~' || p_partkey || '","worker":{{"z":[' || p_size || ',"x"],"a":true}}}},',
    '  "size": ' || p_size || ',', '  "none": null,', '  "price": ' || CAST(CAST(price AS DOUBLE) AS VARCHAR), '}}', ''], chr(10)) AS pretty FROM p""",
)
def _(spark, sf):
    return V.part_json(spark, sf).select("p_partkey", json_pretty(json_object(F.col("doc"))).alias("pretty"))


# Versions whose keys come and go: the event type is a key.
KEYED = """
keyed AS (SELECT *, regexp_extract(props, '([0-9]+)', 1) AS k FROM events),
pairs AS (SELECT event_id, event_type, k, lag(event_type) OVER w AS old_type, lag(k) OVER w AS old_k, lag(event_id) OVER w AS old_id
  FROM keyed WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@query(
    "k6_json_entry_diff",
    f"""WITH {KEYED} SELECT event_id, 'k' AS json_key, 'changed' AS change, old_k AS old_value, k AS new_value FROM pairs WHERE old_id IS NOT NULL AND old_k <> k
    UNION ALL SELECT event_id, event_type, 'changed', CAST(old_id AS VARCHAR), CAST(event_id AS VARCHAR) FROM pairs WHERE old_type = event_type
    UNION ALL SELECT event_id, event_type, 'added', NULL, CAST(event_id AS VARCHAR) FROM pairs WHERE old_type <> event_type
    UNION ALL SELECT event_id, old_type, 'removed', CAST(old_id AS VARCHAR), NULL FROM pairs WHERE old_type <> event_type""",
)
def _(spark, sf):
    doc = F.concat(
        F.substring("props", F.lit(1), F.length("props") - 1), F.lit(', "'), "event_type", F.lit('": '), "event_id", F.lit("}")
    )
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", doc.alias("doc"))
    pairs = with_previous(events, ["user_id"], ["ts", "event_id"], {"doc": "old_doc"})
    return json_entry_diff(pairs.where("old_doc IS NOT NULL"), ["event_id"], "old_doc", "doc")


@query(
    "k7_json_tokens",
    f"""WITH {V.PART_JSON}, t AS (SELECT p_partkey, ['"version"', '"1.' || p_size || '"', '"name"', '"' || p_name || '"', '"dependencies"', '"' || dep || '"',
    '"^' || p_size || '"', '"alpha"', '"~' || p_partkey || '"', '"worker"', '"z"', '"x"', '"a"', '"size"', '"none"', '"price"'] AS tokens FROM p)
    SELECT p_partkey, array_to_string(tokens, chr(10) || chr(10)) AS strings,
    array_to_string([tokens[i] FOR i IN [1, 3, 5, 6, 8, 10, 11, 13, 14, 15, 16]], chr(10) || chr(10)) AS keys FROM t""",
)
def _(spark, sf):
    doc = F.col("doc")
    return V.part_json(spark, sf).select(
        "p_partkey",
        F.array_join(json_strings(doc), "\n\n").alias("strings"),
        F.array_join(json_all_keys(doc), "\n\n").alias("keys"),
    )


@query(
    "k8_json_nodes",
    f"""WITH {V.PART_JSON}, nodes AS (SELECT p_partkey, unnest([
      ['$', 'OBJECT', NULL], ['$.version', 'STRING', '"1.' || p_size || '"'], ['$.name', 'STRING', '"' || p_name || '"'],
      ['$.dependencies', 'OBJECT', NULL], ['$.dependencies.' || dep, 'STRING', '"^' || p_size || '"'], ['$.dependencies.alpha', 'STRING', '"~' || p_partkey || '"'],
      ['$.dependencies.worker', 'OBJECT', NULL], ['$.dependencies.worker.z', 'ARRAY', NULL], ['$.dependencies.worker.z[0]', 'BIGINT', CAST(p_size AS VARCHAR)],
      ['$.dependencies.worker.z[1]', 'STRING', '"x"'], ['$.dependencies.worker.a', 'BOOLEAN', 'true'], ['$.size', 'BIGINT', CAST(p_size AS VARCHAR)],
      ['$.none', 'VOID', 'null'], ['$.price', 'DECIMAL', rtrim(rtrim(CAST(price AS VARCHAR), '0'), '.')]]) AS n FROM p)
    SELECT p_partkey, n[1] AS path, n[2] AS kind, n[3] AS value FROM nodes""",
)
def _(spark, sf):
    return json_nodes(V.part_json(spark, sf), ["p_partkey"], "doc")


# --- XML ------------------------------------------------------------------------------------------------


def _sound_xml(spark, sf):
    """The documents and what is sound of them, found out once for all expressions."""
    return V.part_xml(spark, sf).withColumn("sound", well_formed(F.col("doc")))


@query(
    "x1_xpath_value",
    f"""WITH {V.PART_XML} SELECT p_partkey, CASE WHEN sound THEN p_name ELSE '' END AS name, CASE WHEN sound THEN CAST(p_size AS VARCHAR) ELSE '' END AS size,
    CASE WHEN sound THEN CASE WHEN p_size % 2 = 0 THEN CAST(p_size // 2 AS VARCHAR) ELSE (p_size // 2) || '.5' END ELSE '' END AS half,
    CASE WHEN sound THEN CAST(p_size > 25 AS VARCHAR) ELSE '' END AS big FROM p""",
)
def _(spark, sf):
    doc, sound = F.col("doc"), F.col("sound")
    return _sound_xml(spark, sf).select(
        "p_partkey",
        xpath_value(doc, 'string(//*[local-name()="name"])', sound=sound).alias("name"),
        xpath_value(doc, "//size", "number", sound=sound).alias("size"),
        xpath_value(doc, "number(//size) div 2", "number", sound=sound).alias("half"),
        xpath_value(doc, "//size > 25", "boolean", sound=sound).alias("big"),
    )


@query(
    "x2_xpath_nodes",
    f"""WITH {V.PART_XML} SELECT p_partkey, CASE WHEN sound THEN p_size || '.1' || chr(10) || p_partkey || '.2' ELSE '' END AS versions,
    CASE WHEN sound THEN 'a' || chr(10) || 'b' ELSE '' END AS kinds, CASE WHEN sound THEN p_partkey || '.2' ELSE '' END AS second FROM p""",
)
def _(spark, sf):
    doc, sound = F.col("doc"), F.col("sound")
    return _sound_xml(spark, sf).select(
        "p_partkey",
        xpath_nodes(doc, "//dep/version", sound=sound).alias("versions"),
        xpath_nodes(doc, "//dep/@kind", sound=sound).alias("kinds"),
        xpath_nodes(doc, "//dep[@kind='b']/version", sound=sound).alias("second"),
    )


@query(
    "x3_malformed",
    f"WITH {V.PART_XML} SELECT p_partkey, CASE WHEN sound THEN p_name ELSE '' END AS artifact FROM p",
)
def _(spark, sf):
    return V.part_xml(spark, sf).select("p_partkey", xml_extract(F.col("doc"), "string(//name)")["text"].alias("artifact"))


@query(
    "x2_elements",
    f"""WITH {V.PART_XML} SELECT p_partkey, CASE WHEN sound THEN 'a' || chr(10) || p_size || '.1' || chr(10) || 'b' || chr(10) || p_partkey || '.2' ELSE '' END AS elements,
    CASE WHEN sound THEN p_size || '.1' || chr(10) || p_partkey || '.2' ELSE '' END AS texts FROM p""",
)
def _(spark, sf):
    doc, sound = F.col("doc"), F.col("sound")
    return _sound_xml(spark, sf).select(
        "p_partkey",
        xml_extract(doc, "//dep", sound=sound)["text"].alias("elements"),
        xml_extract(doc, "//dep/version/text()[1]", sound=sound)["text"].alias("texts"),
    )


@query(
    "x2_union",
    f"""WITH {V.PART_XML} SELECT p_partkey, CASE WHEN sound THEN p_name || chr(10) || p_size ELSE '' END AS forwards,
    CASE WHEN sound THEN p_name || chr(10) || p_size ELSE '' END AS backwards,
    CASE WHEN sound THEN CAST(p_size > 25 AS VARCHAR) ELSE '' END AS big, CASE WHEN sound THEN '2' ELSE '' END AS n FROM p""",
)
def _(spark, sf):
    doc, sound = F.col("doc"), F.col("sound")
    return _sound_xml(spark, sf).select(
        "p_partkey",
        xml_extract(doc, "//name | //size", sound=sound)["text"].alias("forwards"),
        xml_extract(doc, "//size | //name", sound=sound)["text"].alias("backwards"),
        xml_extract(doc, "//size > 25", sound=sound)["text"].alias("big"),
        xml_extract(doc, "count(//dep)", sound=sound)["text"].alias("n"),
    )


@query("x3_bad_expression", "SELECT p_partkey, '' AS broken, '' AS unknown FROM part")
def _(spark, sf):
    doc = F.col("doc")
    return V.part_xml(spark, sf).select(
        "p_partkey", xml_extract(doc, "//a[")["text"].alias("broken"), xml_extract(doc, "nosuch(//a)")["text"].alias("unknown")
    )


@query(
    "x4_namespaces",
    f"""WITH {V.PART_XML} SELECT p_partkey, CASE WHEN sound THEN p_brand ELSE '' END AS prefixed, CASE WHEN sound THEN p_name ELSE '' END AS by_default FROM p""",
)
def _(spark, sf):
    doc, spaces = F.col("doc"), {"q": "http://x.org/m", "d": "http://x.org/4"}
    return V.part_xml(spark, sf).select(
        "p_partkey",
        xpath_nodes(doc, "//q:deps/q:v", spaces).alias("prefixed"),
        xpath_value(doc, "string(/d:project/d:name)", "string", spaces).alias("by_default"),
    )


@query(
    "x5_element_markup",
    """SELECT page_id, array_to_string(regexp_extract_all(html, '(?s)<a\\s[^>]*>.*?</a>'), chr(10)) AS links,
    array_to_string(regexp_extract_all(html, '(?s)<title>.*?</title>'), chr(10)) AS titles FROM pages""",
)
def _(spark, sf):
    html = F.col("html")
    return table(spark, sf, "pages").select(
        "page_id",
        F.array_join(element_markup(html, "a"), "\n").alias("links"),
        F.array_join(element_markup(html, "title"), "\n").alias("titles"),
    )


_NESTED = """'<div class="k>' || k || '">' || repeat('<div>', d) || k || repeat('</div >', d) || '</div>'"""


@query(
    "x5_nested_markup",
    f"""SELECT p_partkey, {_NESTED} || chr(10) || '<div/>' || chr(10) || '<div><divider>' || p_brand || '</div>' AS divs,
    '<b><i>' || p_name || '</b>' AS bold FROM (SELECT *, CAST(p_partkey AS VARCHAR(20)) AS k, CAST(1 + p_size % 12 AS INT) AS d FROM part)""",
)
def _(spark, sf):
    parts = dealt_out(table(spark, sf, "part")).selectExpr("*", "CAST(p_partkey AS VARCHAR(20)) AS k", "CAST(1 + p_size % 12 AS INT) AS d")
    doc = f"""'</div></b><div>' || {_NESTED} || '<!-- <div> --><div/><b><i>' || p_name || '</b><![CDATA[</div>]]><div><divider>' || p_brand || '</div>'"""
    doc = F.expr(doc)
    return parts.select(
        "p_partkey",
        F.array_join(element_markup(doc, "div"), "\n").alias("divs"),
        F.array_join(element_markup(doc, "b"), "\n").alias("bold"),
    )


# --- code -----------------------------------------------------------------------------------------------


def _context_list(found: Column, content: Column) -> Column:
    """The context of one side as a JSON list: an empty text has no matches, a missing one has no list."""
    return F.coalesce(F.get(found["context"], F.lit(0)), F.when(content.isNotNull(), "[]"))


FUNCTIONS = V.PART_CODE + """,
f AS (SELECT *, CASE form WHEN 0 THEN [word || p_partkey, other] WHEN 4 THEN CAST([] AS VARCHAR[]) ELSE [word || p_partkey] END AS names,
  CASE form
    WHEN 0 THEN ['export function ' || word || p_partkey || '(a: string) {' || chr(10) || '  if (a) {' || chr(10) || '    return 1' || chr(10) || '  }' || chr(10) || '}',
                 'export async function ' || other || '() { return ' || p_partkey || ' }']
    WHEN 1 THEN ['def ' || word || p_partkey || '(a):' || chr(10) || '    return a']
    WHEN 2 THEN ['func ' || word || p_partkey || '(a int) int {' || chr(10) || chr(9) || 'return a' || chr(10) || '}']
    WHEN 3 THEN ['pub fn ' || word || p_partkey || '(a: u32) -> u32 {' || chr(10) || '    a' || chr(10) || '}']
    ELSE CAST([] AS VARCHAR[]) END AS bodies FROM p)"""


@query(
    "c1_declarations",
    f"""WITH {FUNCTIONS} SELECT p_partkey, array_to_string(names, ',') AS functions, array_to_string(bodies, chr(10) || chr(10)) AS bodies,
    CASE form WHEN 1 THEN other_title WHEN 4 THEN title ELSE '' END AS classes, CASE WHEN form IN (2, 3) THEN title ELSE '' END AS structs,
    '[' || array_to_string(list_transform(names, lambda n: '{{"name":"' || n || '"}}'), ',') || ']' AS context FROM f""",
)
def _(spark, sf):
    path, code = F.col("path"), F.col("code")
    found = code_extract(code, path, "function")
    return V.part_code(spark, sf).select(
        "p_partkey",
        F.array_join(declarations(path, code, "function")["names"], ",").alias("functions"),
        found["text"].alias("bodies"),
        code_extract(code, path, "class", "name")["text"].alias("classes"),
        code_extract(code, path, "struct", "name")["text"].alias("structs"),
        _context_list(found, code).alias("context"),
    )


# Declarations inside declarations, brackets 2 to 24 deep, headers over several lines, brackets in strings. The texts
# are written in SQL that both engines read: (path, code, functions, methods, classes) by language.
_NL = "chr(10)"
_DEEP = "repeat('{ a(', d) || '1' || repeat('); }', d)"
_K = "CAST(k AS VARCHAR(20))"


def _sql_text(text: str) -> str:
    """A text with @K (key), @D (deep block) and line breaks as an SQL expression."""
    out = text.replace("'", "' || chr(39) || '").replace("\n", f"' || {_NL} || '")
    return "'" + out.replace("@K", f"' || {_K} || '").replace("@D", f"' || {_DEEP} || '") + "'"


_INNER_JS = 'function inner@K() { return "}" }'
_OUTER_JS = "function outer@K(a = {b: [1]},\n    c) {\n  " + _INNER_JS + "\n  @D\n}"
_METHOD_JS = "run@K(a, f = (1)) {\n    if (a) { @D }\n  }"
_CLASS_JS = "class Box@K extends Base {\n  " + _METHOD_JS + "\n}"
_INNER_TS = "async function inner@K(): Promise<{ c: string }> { @D }"
_OUTER_TS = "export function outer@K(\n  a: { b: number },\n): void {\n  " + _INNER_TS + "\n}"
_METHOD_TS = "public async run@K<T>(a: T): Promise<T> {\n    return `}` + a // }\n  }"
_CLASS_TS = "export abstract class Box@K {\n  " + _METHOD_TS + "\n  abstract other(): void;\n}"
_INNER_PY = "def inner@K():\n        return '''\nnot a line'''"
_OUTER_PY = "async def outer@K(a,\n        b=')'):\n    " + _INNER_PY + "\n\n    # the end\n    return inner@K"
_METHOD_PY = "def run@K(self): return 1"
_CLASS_PY = "class Box@K(Base):\n    " + _METHOD_PY
_ONE_GO = "func outer@K(a interface{}, f func() struct{}) interface{} {\n\t@D\n}"
_TWO_GO = "func inner@K() { a := '}'; b(a) }"
_METHOD_GO = "func (h *Box@K) run@K(\n\ta int,\n) (int, error) {\n\treturn 1, nil // {\n}"
_METHOD_JAVA = "public static <T> int run@K(int a)\n      throws E {\n    char c = '{';\n    @D\n  }"
_INNER_JAVA = "class In@K {}"
_CLASS_JAVA = "public final class Box@K {\n  " + _METHOD_JAVA + "\n  " + _INNER_JAVA + "\n}"
_INNER_RS = "fn inner@K<'a>(x: &'a str) -> u8 { b'}' }"
_OUTER_RS = "pub fn outer@K(&self) -> u8\n    where Self: Sized {\n        " + _INNER_RS + "\n        @D\n    }"
_FUNC_C = "static int outer@K(int (*f)(int), char c)\n{\n  if (c == '}') @D\n}"
_TWO_C = 'char *inner@K(void) { return "}"; /* } */ }'
_FUNC_CPP = "int run@K(std::vector<int> a) const {\n    @D\n  }"
_CLASS_CPP = "class Box@K : public Base {\n  " + _FUNC_CPP + "\n}"

NESTED = [
    ("a.js", f"{_OUTER_JS}\n{_CLASS_JS}\n", [_OUTER_JS, _INNER_JS], [_METHOD_JS], [_CLASS_JS]),
    ("a.ts", f"{_OUTER_TS}\n{_CLASS_TS}\n", [_OUTER_TS, _INNER_TS], [_METHOD_TS], [_CLASS_TS]),
    ("a.py", f"{_OUTER_PY}\n\n\n{_CLASS_PY}\nz = 1\n", [_OUTER_PY, _INNER_PY, _METHOD_PY], [_INNER_PY, _METHOD_PY], [_CLASS_PY]),
    ("a.go", f"{_ONE_GO}\n\n{_METHOD_GO}\n{_TWO_GO}", [_ONE_GO, _TWO_GO], [_METHOD_GO], []),
    ("a.java", f"package p;\n{_CLASS_JAVA}\n", [], [_METHOD_JAVA], [_CLASS_JAVA, _INNER_JAVA]),
    ("a.rs", f"impl Box@K {{\n    {_OUTER_RS}\n}}\n", [_OUTER_RS, _INNER_RS], [], []),
    ("a.c", f"int proto@K(int a);\n{_FUNC_C}\n{_TWO_C}\n", [_FUNC_C, _TWO_C], [], []),
    ("a.cpp", f"{_CLASS_CPP};\n", [_FUNC_CPP], [], [_CLASS_CPP]),
]


def _by_language(column: Callable[[tuple], str]) -> str:
    return "CASE p_size % 8 " + " ".join(f"WHEN {i} THEN {column(form)}" for i, form in enumerate(NESTED)) + " END"


def _bodies(at: int) -> str:
    return _by_language(lambda form: f" || {_NL} || {_NL} || ".join(map(_sql_text, form[at])) or "''")


@query(
    "c1_nested_declarations",
    f"""SELECT p_partkey, {_by_language(lambda f: _sql_text(f[0]))} AS path, {_bodies(2)} AS functions, {_bodies(3)} AS methods, {_bodies(4)} AS classes
    FROM (SELECT p_partkey, p_partkey AS k, p_size, CAST(1 + p_size % 12 AS INT) AS d FROM part)""",
)
def _(spark, sf):
    parts = dealt_out(table(spark, sf, "part")).selectExpr("p_partkey", "p_partkey AS k", "p_size", "CAST(1 + p_size % 12 AS INT) AS d")
    path, code = _by_language(lambda f: _sql_text(f[0])), _by_language(lambda f: _sql_text(f[1]))
    parts = parts.selectExpr("p_partkey", f"{path} AS path", f"{code} AS code")
    path, code = F.col("path"), F.col("code")
    return parts.select(
        "p_partkey",
        "path",
        code_extract(code, path, "function")["text"].alias("functions"),
        code_extract(code, path, "method")["text"].alias("methods"),
        code_extract(code, path, "class")["text"].alias("classes"),
    )


_DEEP_PARTS = "(SELECT p_partkey, CAST(p_partkey AS VARCHAR(20)) AS k, CAST(1 + p_size % 12 AS INT) AS d FROM part)"
_DEEP_CALL = """'f(' || repeat('g(', d) || '")"' || repeat(')', d) || ', ' || k || ')'"""
_DEEP_VALUE = "'b.c(' || k || ') + ' || repeat('(', d) || 'x' || repeat(')', d)"
_DEEP_GENERIC = "'Map<string, ' || repeat('Map<k' || k || ', ', d) || '(a: number) => Set<number>' || repeat('>', d) || '>'"
_DEEP_FIRST, _DEEP_LAST = "'h(a, ' || k || '),' || chr(10) || '  [' || k || ', 2]'", "repeat('{', d) || repeat('}', d)"
_DEEP_TYPE = """'type T' || k || ' = "a" | { b: ' || repeat('[', d) || repeat(']', d) || ' }'"""


@query(
    "c2_deep_brackets",
    f"""SELECT p_partkey, {_DEEP_CALL} || chr(10) || chr(10) || 'f([' || k || '])' AS calls, 'const a = ' || {_DEEP_VALUE} || ';' AS assigned,
    '[{{"NAME":"a","VALUE":"' || {_DEEP_VALUE} || '"}}]' AS context, {_DEEP_TYPE} AS types,
    {_DEEP_GENERIC} AS generic, {_DEEP_FIRST} AS first_arguments, {_DEEP_LAST} AS last_argument FROM {_DEEP_PARTS}""",
)
def _(spark, sf):
    code = f"{_DEEP_CALL} || ' + h(f([' || k || ']));' || chr(10) || 'const a = ' || {_DEEP_VALUE} || ';' || chr(10) || {_DEEP_TYPE} || chr(10) || 'z = 1'"
    more = f"'let m: ' || {_DEEP_GENERIC} || ';' || chr(10) || 'g((' || chr(10) || 'last(' || chr(10) || '  ' || {_DEEP_FIRST} || ', ' || {_DEEP_LAST} || ')'"
    parts = dealt_out(table(spark, sf, "part").selectExpr("p_partkey", "CAST(p_partkey AS VARCHAR(20)) AS k", "CAST(1 + p_size % 12 AS INT) AS d"))
    calls, assigned, types = template_extracts(F.col("code"), [("f($$$ARGS)", None), ("const $NAME = $VALUE;", None), ("type $NAME = $TYPE", None)])
    last = "last($$$FIRST, $LAST)"
    generic, first, final = template_extracts(F.col("more"), [("let $NAME: $TYPE;", "TYPE"), (last, "FIRST"), (last, "LAST")])
    return parts.selectExpr("p_partkey", f"{code} AS code", f"{more} AS more").select(
        "p_partkey",
        calls["text"].alias("calls"),
        assigned["text"].alias("assigned"),
        _context_list(assigned, F.col("code")).alias("context"),
        types["text"].alias("types"),
        generic["text"].alias("generic"),
        first["text"].alias("first_arguments"),
        final["text"].alias("last_argument"),
    )


@query(
    "c2_template_extract",
    f"""SELECT doc_id, {sql_matches('text', 'token = "[^"]*"', 'chr(10) || chr(10)')} AS artifact,
    '[' || array_to_string(list_transform(regexp_extract_all(text, 'token = "([^"]*)"', 1), lambda v: '{{"VALUE":' || CAST(to_json(v) AS VARCHAR) || '}}'), ',') || ']' AS context FROM documents""",
)
def _(spark, sf):
    text = F.col("text")
    found = template_extract(text, 'token = "$$$VALUE"')
    return table(spark, sf, "documents").select("doc_id", found["text"].alias("artifact"), _context_list(found, text).alias("context"))


@query(
    "c2_template_names",
    """SELECT c_custkey, c_name AS artifact, '[{"KIND":"Customer","NUM":"' || substr(c_name, 10) || '"}]' AS context FROM customer""",
)
def _(spark, sf):
    name = F.col("c_name")
    found = template_extract(name, "$KIND#$$$NUM")
    return table(spark, sf, "customer").select("c_custkey", found["text"].alias("artifact"), _context_list(found, name).alias("context"))


@query(
    "c3_context_selector",
    """SELECT doc_id, array_to_string(regexp_extract_all(text, 'token = "([^"]*)"', 1), chr(10) || chr(10)) AS artifact FROM documents""",
)
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", template_extract(F.col("text"), 'token = "$$$VALUE"', "VALUE")["text"].alias("artifact")
    )


# --- references, payloads, escaping ---------------------------------------------------------------------

PR_SQL = """
urls AS (SELECT page_id, page_id % 5 AS form, regexp_extract(url, '//([^/]+)/', 1) AS host FROM pages)"""


@query(
    "f1_parse_pr_url",
    f"""WITH {PR_SQL} SELECT page_id, CASE WHEN form < 2 THEN host END AS owner, CASE WHEN form < 2 THEN 'r' || page_id END AS repo,
    CASE WHEN form < 2 THEN page_id END AS number FROM urls""",
)
def _(spark, sf):
    form, host, key = F.col("page_id") % 5, F.regexp_extract("url", "//([^/]+)/", 1), F.col("page_id")
    url = (
        F.when(form == 0, F.concat(F.lit("https://github.com/"), host, F.lit("/r"), key, F.lit("/pull/"), key))
        .when(form == 1, F.concat(F.lit("http://github.com/"), host, F.lit("/r"), key, F.lit("/pull/"), key, F.lit("/files")))
        .when(form == 2, F.concat(F.lit("https://github.com/"), host, F.lit("/r/issues/"), key))
        .when(form == 3, F.concat(F.lit("see https://github.com/"), host, F.lit("/r/pull/"), key))
        .otherwise(F.col("url"))
    )
    return table(spark, sf, "pages").select("page_id", parse_pr_url(url).alias("r")).select("page_id", "r.*")


@query(
    "f2_parse_remote",
    """SELECT s_suppkey, CASE WHEN f < 3 THEN 'remote' || s_nationkey END AS name,
    CASE f WHEN 0 THEN 'git@github.com:org' || s_nationkey || '/repo' || s_suppkey || '.git' WHEN 1 THEN 'https://github.com/org' || s_nationkey || '/repo' || s_suppkey
      WHEN 2 THEN 'https://example.com/a/b' END AS url, CASE WHEN f < 3 THEN f < 2 END AS is_github,
    CASE WHEN f < 2 THEN 'org' || s_nationkey END AS owner, CASE WHEN f < 2 THEN 'repo' || s_suppkey END AS repo
    FROM (SELECT *, s_suppkey % 4 AS f FROM supplier)""",
)
def _(spark, sf):
    form, org, key = F.col("s_suppkey") % 4, F.concat(F.lit("org"), "s_nationkey"), F.col("s_suppkey")
    url = (
        F.when(form == 0, F.concat(F.lit("git@github.com:"), org, F.lit("/repo"), key, F.lit(".git")))
        .when(form == 1, F.concat(F.lit("https://github.com/"), org, F.lit("/repo"), key))
        .otherwise("https://example.com/a/b")
    )
    line = F.concat(F.lit("remote"), "s_nationkey", F.lit("\t"), url, F.when(form == 3, " (push)").otherwise(" (fetch)"))
    return table(spark, sf, "supplier").select("s_suppkey", parse_remote(line).alias("r")).select("s_suppkey", "r.*")


@query(
    "f3_parse_tracking",
    """SELECT s_suppkey, 'r' || s_nationkey AS remote, CASE WHEN s_suppkey % 3 = 0 THEN 'main' WHEN s_suppkey % 3 = 1 THEN 'feat/' || s_name ELSE '' END AS branch FROM supplier""",
)
def _(spark, sf):
    form = F.col("s_suppkey") % 3
    ref = F.concat(F.lit("r"), "s_nationkey", F.when(form == 0, "/main").when(form == 1, F.concat(F.lit("/feat/"), "s_name")).otherwise(""))
    return table(spark, sf, "supplier").select("s_suppkey", parse_tracking(ref).alias("r")).select("s_suppkey", "r.*")


@query("s6_decode_content", "SELECT 'head' AS ref, 'doc_' || doc_id AS path, CASE WHEN lang <> 'fr' THEN text END AS content FROM documents")
def _(spark, sf):
    payload = F.base64(F.encode("text", "utf-8"))
    encoding = F.when(F.col("lang") == "fr", "none").otherwise("base64")
    return snapshots_from(table(spark, sf, "documents"), "head", F.concat(F.lit("doc_"), "doc_id"), payload, encoding)


@query(
    "r2_html_escape",
    """SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'),
    '''', '&#x27;'), '`', '&#x60;'), '=', '&#x3D;') AS escaped FROM documents
    UNION ALL SELECT -1 - page_id, replace(replace(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'),
    '''', '&#x27;'), '`', '&#x60;'), '=', '&#x3D;') FROM pages""",
)
def _(spark, sf):
    pages = table(spark, sf, "pages").select((F.lit(-1) - F.col("page_id")).alias("doc_id"), html_escape(F.col("html")).alias("escaped"))
    return table(spark, sf, "documents").select("doc_id", html_escape(F.col("text")).alias("escaped")).unionByName(pages)
