"""Snapshot joins, rule matching, references, spans."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.paths import effective_path, file_ext, glob_any, language_of
from ..operators.renames import similar_renames
from ..operators.references import resolve_refs, unresolved_refs
from ..operators.rows import dealt_out
from ..operators.snapshots import (
    attach_versions,
    compare_snapshots,
    detect_renames,
    invalid_refs,
    lookup,
    snapshot_diff,
    tree_status,
    valid_refs,
)
from ..operators.spans import first_seen, match_spans, maximal_spans
from ..operators.versions import first_open, first_with_alternatives, last_by_key, version_pairs
from ..plans.reports import Rule, both_missing, match_rules
from ..plans.rule_index import match_rule_index, rule_index
from ..session import checkpoint_root
from ..sources.rules import definition_table, rule_table, signal_table
from ..sources.snapshots import load_snapshots
from . import versions as V
from .registry import query, table


@query(
    "j1_snapshot_diff",
    f"WITH {V.DOCS} SELECT path, type, old_hash, new_hash FROM status WHERE type <> 'same'",
)
def _(spark, sf):
    return snapshot_diff(V.base_snapshot(spark, sf), V.head_snapshot(spark, sf), ["path"], "content")


RENAMES = """
adds AS (SELECT path, new_hash AS hash, row_number() OVER (PARTITION BY new_hash ORDER BY path) AS n FROM status WHERE type = 'add'),
gone AS (SELECT path, old_hash AS hash, row_number() OVER (PARTITION BY old_hash ORDER BY path) AS n FROM status WHERE type = 'delete'),
sources AS (SELECT new_hash AS hash, min(path) AS source FROM status WHERE type = 'same' GROUP BY 1),
moves AS (
  SELECT g.path AS old_path, a.path AS new_path, 'rename' AS type, 100 AS similarity FROM adds a JOIN gone g ON a.hash = g.hash AND a.n = g.n
  UNION ALL SELECT s.source, a.path, CASE WHEN s.source IS NULL THEN 'add' ELSE 'copy' END, CASE WHEN s.source IS NOT NULL THEN 100 END
    FROM adds a LEFT JOIN gone g ON a.hash = g.hash AND a.n = g.n LEFT JOIN sources s ON a.hash = s.hash WHERE g.path IS NULL
  UNION ALL SELECT g.path, NULL, 'delete', NULL FROM gone g LEFT JOIN adds a ON a.hash = g.hash AND a.n = g.n WHERE a.path IS NULL
  UNION ALL SELECT path, path, 'modify', NULL FROM status WHERE type = 'modify')"""


def _moves(spark, sf):
    base, head = V.base_snapshot(spark, sf), V.head_snapshot(spark, sf)
    return detect_renames(compare_snapshots(base, head, ["path"], "content"))


@query("j2_detect_renames", f"WITH {V.DOCS}, {RENAMES} SELECT * FROM moves")
def _(spark, sf):
    return _moves(spark, sf)


# Moved documents that were also edited: a line more, and with an even id another first line.
EDITED = V.DOCS.replace(
    "CASE edit WHEN 3",
    "CASE edit WHEN 2 THEN CASE WHEN doc_id % 20 = 2 THEN text ELSE regexp_replace(text, '^[^\\n]*', 'Another first line.') END "
    "|| chr(10) || 'moved and edited' WHEN 3",
)
SIMILAR = """
unpaired AS (SELECT 'old' AS side, m.old_path AS path, b.content FROM moves m JOIN base b ON b.path = m.old_path WHERE m.type = 'delete'
  UNION ALL SELECT 'new', m.new_path, h.content FROM moves m JOIN head h ON h.path = m.new_path WHERE m.type = 'add'),
sets AS (SELECT side, path, list_sort(list_distinct(list_filter(string_split(content, chr(10)), lambda x: x <> ''))) AS lines FROM unpaired),
members AS (SELECT side, path, lines, min(path) OVER g AS first, count(*) OVER g AS size, row_number() OVER (PARTITION BY side, lines ORDER BY path) - 1 AS at
  FROM sets WHERE len(lines) > 0 WINDOW g AS (PARTITION BY side, lines)),
classes AS (SELECT DISTINCT side, lines, first, size FROM members),
tokens AS (SELECT side, first, unnest(lines) AS line FROM classes),
kept AS (SELECT * FROM tokens WHERE line NOT IN (SELECT line FROM tokens GROUP BY line HAVING count(*) > 1000)),
sizes AS (SELECT side, first, count(*) AS n FROM kept GROUP BY ALL),
shared AS (SELECT o.first AS old_first, w.first AS new_first, count(*) AS n FROM kept o JOIN kept w ON o.side = 'old' AND w.side = 'new' AND o.line = w.line GROUP BY ALL),
scored AS (SELECT old_first, new_first, (100 * s.n // greatest(o.n, w.n))::INTEGER AS similarity FROM shared s
    JOIN sizes o ON o.side = 'old' AND o.first = old_first JOIN sizes w ON w.side = 'new' AND w.first = new_first
  UNION SELECT o.first, w.first, 100 FROM classes o JOIN classes w ON o.side = 'old' AND w.side = 'new' AND o.lines = w.lines),
pairs AS (SELECT old_first, new_first, max(similarity) AS similarity FROM scored WHERE similarity >= 50 GROUP BY ALL),
rounds AS (SELECT 1 AS round, old_first, new_first, similarity, o.size AS old_left, w.size AS new_left,
    regexp_extract(old_first, '[^/]*$') <> regexp_extract(new_first, '[^/]*$') AS named, md5(old_first || chr(10) || new_first) AS tie FROM pairs
    JOIN classes o ON o.side = 'old' AND o.first = old_first JOIN classes w ON w.side = 'new' AND w.first = new_first
  UNION ALL SELECT round + 1, old_first, new_first, similarity, old_left - old_used, new_left - new_used, named, tie FROM (
    SELECT *, max(times) OVER (PARTITION BY old_first) AS old_used, max(times) OVER (PARTITION BY new_first) AS new_used FROM (
      SELECT *, CASE WHEN row_number() OVER (PARTITION BY old_first ORDER BY similarity DESC, named, tie) = 1
        AND row_number() OVER (PARTITION BY new_first ORDER BY similarity DESC, named, tie) = 1 THEN least(old_left, new_left) ELSE 0 END AS times FROM rounds))
  WHERE old_left > old_used AND new_left > new_used),
taken AS (SELECT * FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY round, old_first ORDER BY similarity DESC, named, tie) = 1
    AND row_number() OVER (PARTITION BY round, new_first ORDER BY similarity DESC, named, tie) = 1 THEN least(old_left, new_left) ELSE 0 END AS times FROM rounds) WHERE times > 0),
renamed AS (SELECT o.path AS old_path, w.path AS new_path, 'rename' AS type, similarity FROM taken t
  JOIN members o ON o.side = 'old' AND o.first = old_first AND o.at >= o.size - old_left AND o.at < o.size - old_left + times
  JOIN members w ON w.side = 'new' AND w.first = new_first AND w.at - (w.size - new_left) = o.at - (o.size - old_left))
SELECT * FROM renamed
UNION ALL SELECT * FROM moves WHERE NOT (type = 'delete' AND old_path IN (SELECT old_path FROM renamed)) AND NOT (type = 'add' AND new_path IN (SELECT new_path FROM renamed))"""


@query("j2_similar_renames", f"WITH RECURSIVE {EDITED}, {RENAMES}, {SIMILAR}")
def _(spark, sf):
    moved = F.regexp_extract("path", r"^moved/.*doc_(\d+)\.txt$", 1)
    other = F.when(moved.cast("bigint") % 20 == 2, F.col("content")).otherwise(F.regexp_replace("content", r"\A[^\n]*", "Another first line."))
    edited = F.when(moved == "", F.col("content")).otherwise(F.concat(other, F.lit("\nmoved and edited")))
    head = V.head_snapshot(spark, sf).select("path", edited.alias("content"))
    return similar_renames(V.base_snapshot(spark, sf), head)


# Rules by path only: what the changed documents are matched against.
PATH_RULES = [
    Rule("english", 0, 0, ("src*/en/**",), "regex", {"pattern": "a"}),
    Rule("numbered", 1, 0, ("src?/{fr,de}/doc_[0-4]*.txt", "moved/**/doc_*1?.txt"), "regex", {"pattern": "a"}),
    Rule("numbered", 1, 1, ("!**/es/*",), "regex", {"pattern": "a"}),
    Rule("hidden", 2, 0, ("*", "**/.*"), "regex", {"pattern": "a"}),
]

PATH_MATCH = """
matched AS (
  SELECT *, 0 AS rule_no FROM files WHERE regexp_matches(file_path, '^src[^/]*/en/[^/]+(/[^/]+)*$')
  UNION ALL SELECT *, 1 FROM files WHERE regexp_matches(file_path, '^src[^/]/(fr|de)/doc_[0-4][^/]*\\.txt$')
    OR regexp_matches(file_path, '^moved/(.+/)?doc_[^/]*1[^/]\\.txt$')
  UNION ALL SELECT *, 2 FROM files WHERE NOT regexp_matches(file_path, '^([^/]+/)*es/[^/]+$'))"""

FILES = "files AS (SELECT *, coalesce(new_path, old_path) AS file_path FROM moves)"


@query(
    "j3_match_rules",
    f"WITH {V.DOCS}, {RENAMES}, {FILES}, {PATH_MATCH} SELECT old_path, new_path, type, similarity, rule_no FROM matched",
)
def _(spark, sf):
    return match_rules(_moves(spark, sf), PATH_RULES)


# One rule for each source and language, and rules for all files of some kind: as many rules as there are folders.
INDEXED = """
folders AS (SELECT DISTINCT source, lang FROM documents),
numbered AS (SELECT *, (row_number() OVER (ORDER BY source NULLS FIRST, lang NULLS FIRST) - 1)::INTEGER AS rule_no FROM folders),
found AS (SELECT f.*, n.rule_no FROM files f JOIN numbered n
    ON starts_with(file_path, n.source || '/' || n.lang || '/') OR starts_with(file_path, 'moved/' || n.source || '/' || n.lang || '/')
  UNION ALL SELECT f.*, r.n + 1000000 FROM files f, range(10) r(n) WHERE regexp_matches(file_path, r.n || '[.]txt$')
  UNION ALL SELECT *, 2000000 FROM files)"""


@query(
    "j3_rule_index",
    f"WITH {V.DOCS}, {RENAMES}, {FILES}, {INDEXED} SELECT old_path, new_path, type, similarity, rule_no::INTEGER AS rule_no FROM found",
)
def _(spark, sf):
    folder = F.concat("source", F.lit("/"), "lang", F.lit("/**"))
    order = F.expr("CAST(row_number() OVER (ORDER BY source NULLS FIRST, lang NULLS FIRST) - 1 AS INT) AS rule_no")
    own = table(spark, sf, "documents").select("source", "lang").distinct().select(order, F.array(folder, F.concat(F.lit("{moved,gone}/"), folder)).alias("include"))
    own = own.where("include[0] IS NOT NULL")
    kinds = spark.range(10).selectExpr("CAST(id + 1000000 AS INT) AS rule_no", "array(concat('**/*', id, '.txt'), concat('**/doc_*', id, '.txt')) AS include")
    every = spark.range(1).selectExpr("2000000 AS rule_no", "array('!nothing/*', '**') AS include")
    return match_rule_index(_moves(spark, sf), rule_index(own.unionByName(kinds).unionByName(every)))


@query(
    "p1_glob_any",
    f"WITH {V.DOCS}, files AS (SELECT doc_id, path AS file_path FROM docs), {PATH_MATCH} "
    "SELECT doc_id, file_path AS path, bool_or(rule_no = 0) AS english, bool_or(rule_no = 1) AS numbered FROM "
    "(SELECT * FROM matched UNION ALL SELECT *, 9 FROM files) GROUP BY ALL",
)
def _(spark, sf):
    path = F.col("path")
    return V.documents(spark, sf).select(
        "doc_id",
        "path",
        glob_any(path, PATH_RULES[0].include).alias("english"),
        glob_any(path, PATH_RULES[1].include).alias("numbered"),
    )


@query(
    "j4_attach_versions",
    f"""WITH {V.DOCS}, {RENAMES} SELECT m.old_path, m.new_path, m.type, m.similarity,
    b.content AS old_content, h.content AS new_content FROM moves m
    LEFT JOIN base b ON m.type <> 'add' AND b.path = m.old_path LEFT JOIN head h ON m.type <> 'delete' AND h.path = m.new_path""",
)
def _(spark, sf):
    return attach_versions(_moves(spark, sf), V.snapshots(spark, sf), V.BASE, V.HEAD)


# Change rows for documents as declared by their form, without looking at the snapshots: some name no file.
DECLARED = """
declared AS (SELECT doc_id, path, CASE edit WHEN 0 THEN 'delete' WHEN 1 THEN 'add' ELSE 'modify' END AS type FROM docs),
attached AS (SELECT d.doc_id, d.path, d.type, b.content AS old_content, h.content AS new_content FROM declared d
  LEFT JOIN base b ON d.type <> 'add' AND b.path = d.path LEFT JOIN head h ON d.type <> 'delete' AND h.path = d.path)"""


def _declared(spark, sf, old_prefix=""):
    edit = F.col("edit")
    return V.documents(spark, sf).select(
        "doc_id",
        F.concat(F.lit(old_prefix), "path").alias("old_path"),
        F.col("path").alias("new_path"),
        F.when(edit == 0, "delete").when(edit == 1, "add").otherwise("modify").alias("type"),
    )


@query(
    "p3_side_guards",
    f"WITH {V.DOCS}, {DECLARED} SELECT doc_id, type, old_content IS NOT NULL AS has_old, new_content IS NOT NULL AS has_new FROM attached",
)
def _(spark, sf):
    rows = attach_versions(_declared(spark, sf), V.snapshots(spark, sf), V.BASE, V.HEAD)
    return rows.select(
        "doc_id", "type", F.col("old_content").isNotNull().alias("has_old"), F.col("new_content").isNotNull().alias("has_new")
    )


@query(
    "p4_both_missing",
    f"""WITH {V.DOCS}, {DECLARED} SELECT doc_id, type FROM (SELECT d.doc_id, d.type, h.content AS new_content
    FROM declared d LEFT JOIN head h ON d.type <> 'delete' AND h.path = d.path) WHERE new_content IS NOT NULL""",
)
def _(spark, sf):
    # The old paths name nothing, so only the new side can be there.
    changes = _declared(spark, sf, "nowhere/")
    rows = attach_versions(changes, V.snapshots(spark, sf), V.BASE, V.HEAD)
    return rows.where(~both_missing()).select("doc_id", "type")


@query(
    "s5_lookup",
    f"WITH {V.DOCS} SELECT 'head' AS ref, d.path, h.content FROM docs d LEFT JOIN head h USING (path)",
)
def _(spark, sf):
    requests = V.documents(spark, sf).select(F.lit(V.HEAD).alias("ref"), "path")
    return lookup(requests, V.snapshots(spark, sf)).select("ref", "path", "content")


# Signals with references, one configuration per part: the type names a watch that only some parts define.
CONFIG_SQL = "SELECT p_partkey, lower(p_type) AS dep, p_name, p_size FROM part"


def _configs(spark, sf):
    dep, name, size = F.lower("p_type"), F.col("p_name"), F.col("p_size")
    text = F.concat(
        F.lit('{"concerns": {"zeta": {"signals": [{"watch": {"include": "'), dep, F.lit('/*.json", "type": "jq", "query": ".size"},'),
        F.lit(' "report": {"type": "handlebars", "template": "'), name, F.lit(' {{diffText}}"}, "notify": {"slack": "#'), dep,
        F.lit('"}}, {"use": "#defined/signals/shared"}]}, "alpha": {"signals": [{"watch": {"use": "#defined/watches/'), dep,
        F.lit('"}, "report": {"use": "#defined/reports/r'), size,
        F.lit('"}}]}}, "defined": {"signals": {"shared": {"watch": {"use": "#defined/watches/'), dep,
        F.lit('"}, "report": {"type": "handlebars", "template": "shared"}, "notify": {"email": "a@b.c"}}}, "watches": {"'), dep,
        F.lit('": {"include": ["**/'), name, F.lit('.txt", "b"], "type": "regex", "pattern": "'), name,
        F.lit('", "flags": "i"}}, "reports": {"r'), size, F.lit('": {"type": "handlebars", "template": "size '), size, F.lit('"}}}}'),
    )
    return dealt_out(table(spark, sf, "part")).select("p_partkey", text.alias("config"))


@query(
    "s1_rule_table",
    f"""SELECT p_partkey, 'zeta' AS concern_id, 0 AS concern_pos, 0 AS signal_pos, dep || '/*.json' AS include, 'jq' AS watch_type,
    'query=.size' AS params, p_name || ' {{{{diffText}}}}' AS template, 'slack=#' || dep AS notify FROM ({CONFIG_SQL})
    UNION ALL SELECT p_partkey, 'zeta', 0, 1, NULL, NULL, NULL, NULL, NULL FROM part
    UNION ALL SELECT p_partkey, 'alpha', 1, 0, NULL, NULL, '', NULL, NULL FROM part""",
)
def _(spark, sf):
    rules = rule_table(_configs(spark, sf), ["p_partkey"], "config")
    return _flat_rules(rules)


def _flat_rules(rules):
    def flat(name):
        return F.array_join(F.transform(F.map_entries(name), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias(name)

    return rules.select(
        "p_partkey", "concern_id", "concern_pos", "signal_pos", F.array_join("include", ";").alias("include"),
        "watch_type", flat("params"), "template", flat("notify"),
    )


@query(
    "j5_resolve_refs",
    f"""SELECT p_partkey, 'zeta' AS concern_id, 0 AS concern_pos, 0 AS signal_pos, dep || '/*.json' AS include, 'jq' AS watch_type,
    'query=.size' AS params, p_name || ' {{{{diffText}}}}' AS template, 'slack=#' || dep AS notify FROM ({CONFIG_SQL})
    UNION ALL SELECT p_partkey, 'zeta', 0, 1, '**/' || p_name || '.txt;b', 'regex', 'pattern=' || p_name || ';flags=i', 'shared', 'email=a@b.c' FROM part
    UNION ALL SELECT p_partkey, 'alpha', 1, 0, '**/' || p_name || '.txt;b', 'regex', 'pattern=' || p_name || ';flags=i', 'size ' || p_size, NULL FROM part""",
)
def _(spark, sf):
    from ..sources.rules import rule_columns

    configs, keys = _configs(spark, sf), ["p_partkey"]
    resolved = resolve_refs(signal_table(configs, keys, "config"), definition_table(configs, keys, "config"), keys)
    return _flat_rules(rule_columns(resolved, keys))


USES = """
uses AS (SELECT o_orderkey, '#defined/' || CASE o_orderstatus WHEN 'O' THEN 'watches' WHEN 'F' THEN 'reports' ELSE 'signals' END
  || '/' || o_orderpriority AS use, CASE o_orderstatus WHEN 'O' THEN 'watches' WHEN 'F' THEN 'reports' ELSE 'signals' END AS kind,
  o_orderpriority AS name FROM orders)"""


def _uses(spark, sf):
    status = F.col("o_orderstatus")
    kind = F.when(status == "O", "watches").when(status == "F", "reports").otherwise("signals")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.lit("#defined/"), kind, F.lit("/"), "o_orderpriority").alias("use")
    )


@query(
    "j6_unresolved_refs",
    f"""WITH {USES}, defs AS (SELECT DISTINCT kind, name FROM uses WHERE kind = 'watches' OR name LIKE '%H%')
    SELECT o_orderkey, use, kind, name FROM uses ANTI JOIN defs USING (kind, name)""",
)
def _(spark, sf):
    from ..functions.refs import parse_use

    uses = _uses(spark, sf)
    parsed = uses.select(parse_use(F.col("use")).alias("r")).select("r.*")
    definitions = parsed.where((F.col("kind") == "watches") | F.col("name").contains("H")).distinct()
    return unresolved_refs(uses, "use", definitions, []).select("o_orderkey", "use", "kind", "name")


@query("f4_parse_use", f"WITH {USES} SELECT * FROM uses")
def _(spark, sf):
    from ..functions.refs import parse_use

    return _uses(spark, sf).select("o_orderkey", "use", parse_use(F.col("use")).alias("r")).select("o_orderkey", "use", "r.*")


REF_SQL = """
changed AS (SELECT event_id, CASE event_type WHEN 'view' THEN '' WHEN 'error' THEN '.' ELSE event_type || '-' || user_id END AS ref FROM events),
refs AS (SELECT DISTINCT o_orderstatus AS ref FROM orders UNION SELECT DISTINCT event_type || '-' || user_id FROM events WHERE value > 60
  UNION SELECT '' UNION SELECT '.')"""


def _refs(spark, sf):
    events = table(spark, sf, "events")
    named = F.concat("event_type", F.lit("-"), "user_id")
    changes = events.select(
        "event_id",
        F.when(F.col("event_type") == "view", "").when(F.col("event_type") == "error", ".").otherwise(named).alias("ref"),
    )
    special = events.select(F.explode(F.array(F.lit(""), F.lit("."))).alias("ref"))
    refs = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("ref")).union(
        events.where("value > 60").select(named.alias("ref"))
    ).union(special).distinct()
    return changes, refs


@query("j7_valid_refs", f"WITH {REF_SQL} SELECT event_id, ref FROM changed SEMI JOIN (SELECT * FROM refs WHERE ref NOT IN ('', '.')) USING (ref)")
def _(spark, sf):
    return valid_refs(*_refs(spark, sf)).select("event_id", "ref")


@query("j7_invalid_refs", f"WITH {REF_SQL} SELECT DISTINCT ref FROM changed ANTI JOIN (SELECT * FROM refs WHERE ref NOT IN ('', '.')) USING (ref)")
def _(spark, sf):
    return invalid_refs(*_refs(spark, sf))


@query(
    "j8_maximal_spans",
    f"""WITH {V.SPANS} SELECT match_id, event_id, event_type, "start", "end" FROM spans c WHERE NOT EXISTS (SELECT 1 FROM spans o WHERE o.match_id = c.match_id
    AND o."start" <= c."start" AND o."end" >= c."end" AND (o."start" < c."start" OR o."end" > c."end"))""",
)
def _(spark, sf):
    spans = V.event_spans(spark, sf)
    return maximal_spans(spans, "match_id", "start", "end")


@query(
    "a2_first_seen",
    f"""WITH {V.SPANS} SELECT event_type AS side, match_id AS node, min_by(event_id, ("start", event_id)) AS event_id, min("start") AS "start"
    FROM spans GROUP BY 1, 2""",
)
def _(spark, sf):
    spans = V.event_spans(spark, sf).select(F.col("event_type").alias("side"), F.col("match_id").alias("node"), "event_id", "start")
    return first_seen(spans, ["side", "node"], ["start", "event_id"], []).select("side", "node", "event_id", "start")


WORDS = r"[A-Z][a-z]+ing\b"


@query(
    "e4_match_spans",
    f"""WITH parts AS (SELECT doc_id, regexp_extract_all(text, '{WORDS}') AS found, string_split_regex(text, '{WORDS}') AS gaps FROM documents),
    rows AS (SELECT doc_id, i - 1 AS pos, length(gaps[i]) AS gap, found[i] AS match FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM parts))
    SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(sum(gap + length(match)) OVER w - length(match) AS BIGINT) AS "start", CAST(sum(gap + length(match)) OVER w AS BIGINT) AS "end", match
    FROM rows WINDOW w AS (PARTITION BY doc_id ORDER BY pos)""",
)
def _(spark, sf):
    return match_spans(table(spark, sf, "documents"), ["doc_id"], "text", WORDS)


EXTENSIONS = """
paths AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) || CASE page_id % 9 WHEN 0 THEN 'a.PY' WHEN 1 THEN 'x.test.tsx'
  WHEN 2 THEN 'm.go' WHEN 3 THEN '.bashrc' WHEN 4 THEN 'lib.hpp' WHEN 5 THEN 'dot.' WHEN 6 THEN 'data.json' ELSE '' END AS path FROM pages),
exts AS (SELECT *, CASE WHEN regexp_matches(path, '(^|/)\\.\\./*$') THEN '' ELSE lower(regexp_extract(path, '[^/](\\.[^./]*)/*$', 1)) END AS ext FROM paths)"""


def _page_paths(spark, sf):
    form = F.col("page_id") % 9
    name = F.lit("")
    for i, n in enumerate(["a.PY", "x.test.tsx", "m.go", ".bashrc", "lib.hpp", "dot.", "data.json"]):
        name = F.when(form == i, n).otherwise(name)
    path = F.regexp_extract("url", r"^https?://[^/]+([^?#]*)", 1)
    return table(spark, sf, "pages").select("page_id", F.concat(path, name).alias("path"))


@query("f5_file_ext", f"WITH {EXTENSIONS} SELECT page_id, path, ext FROM exts")
def _(spark, sf):
    return _page_paths(spark, sf).select("page_id", "path", file_ext(F.col("path")).alias("ext"))


@query(
    "j9_with_language",
    f"""WITH {EXTENSIONS} SELECT page_id, ext, CASE ext WHEN '.py' THEN 'python' WHEN '.tsx' THEN 'typescript' WHEN '.go' THEN 'go'
    WHEN '.hpp' THEN 'cpp' WHEN '.json' THEN 'json' END AS language, 'rust' AS overridden FROM exts""",
)
def _(spark, sf):
    path = F.col("path")
    return _page_paths(spark, sf).select(
        "page_id",
        file_ext(path).alias("ext"),
        language_of(path, strict=False).alias("language"),
        language_of(path, ".rs").alias("overridden"),
    )


@query(
    "p2_effective_path",
    f"""WITH {V.ORDERS} SELECT diff_id, CASE form WHEN 3 THEN 'done/' || path ELSE path END AS file_path FROM o WHERE form < 4
    UNION ALL SELECT diff_id, 'logo.png' FROM o WHERE form = 3""",
)
def _(spark, sf):
    from ..sources.patches import diff_files

    files = diff_files(V.order_diffs(spark, sf), ["diff_id"], "diff_text")
    return files.select("diff_id", effective_path(F.col("new_path"), F.col("old_path")).alias("file_path"))


@query(
    "a5_tree_status",
    f"""WITH {V.DOCS},
    idx AS (SELECT path, CASE edit WHEN 3 THEN text || chr(10) || 'appended line' WHEN 4 THEN text || chr(10) || 'token = "t' || doc_id || '"' ELSE text END AS content
      FROM docs WHERE edit <> 1),
    merged AS (SELECT coalesce(b.path, i.path, h.path) AS path, b.content AS c0, i.content AS c1, h.content AS c2
      FROM base b FULL JOIN idx i ON b.path = i.path FULL JOIN head h ON coalesce(b.path, i.path) = h.path),
    flags AS (SELECT regexp_extract(path, '(src[0-9]+/[a-z]+)/', 1) AS repo, bool_or(c0 IS DISTINCT FROM c1) AS has_staged, bool_or(c1 IS DISTINCT FROM c2) AS has_unstaged
      FROM merged GROUP BY 1)
    SELECT repo, has_staged, has_unstaged, NOT has_staged AND NOT has_unstaged AS is_clean FROM flags""",
)
def _(spark, sf):
    edit, text = F.col("edit"), F.col("text")
    index = V.documents(spark, sf).where("edit <> 1").select(
        "path",
        F.when(edit == 3, F.concat(text, F.lit("\nappended line")))
        .when(edit == 4, F.concat(text, F.lit('\ntoken = "t'), "doc_id", F.lit('"')))
        .otherwise(text)
        .alias("content"),
    )
    repo = F.regexp_extract("path", r"(src[0-9]+/[a-z]+)/", 1).alias("repo")
    sides = [df.select(repo, "path", "content") for df in (V.base_snapshot(spark, sf), index, V.head_snapshot(spark, sf))]
    return tree_status(*sides, "repo", ["path"], "content")


@query(
    "w2_version_pairs",
    f"WITH {V.TURNS} SELECT conv_id, turn, old_content, new_content FROM turns WHERE before IS NOT NULL",
)
def _(spark, sf):
    return version_pairs(table(spark, sf, "conversations"), ["conv_id"], ["turn"], "text")


@query(
    "w3_first_open",
    """SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate
    FROM orders WHERE o_orderstatus = 'O' GROUP BY 1""",
)
def _(spark, sf):
    order = ["o_orderdate", "o_orderkey"]
    return first_open(table(spark, sf, "orders"), ["o_custkey"], F.col("o_orderstatus") == "O", order, ["o_orderkey", "o_orderdate"])


@query(
    "w4_last_by_key",
    """SELECT event_type, user_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(props, (ts, event_id)) AS props
    FROM events GROUP BY ALL""",
)
def _(spark, sf):
    return last_by_key(table(spark, sf, "events"), ["event_type", "user_id"], ["ts", "event_id"], ["event_id", "props"])


@query(
    "o2_first_with_alternatives",
    """SELECT s_nationkey, s_name, min_by(s_name, (s_acctbal, s_name)) OVER w AS chosen, count(*) OVER w AS candidates
    FROM supplier WINDOW w AS (PARTITION BY s_nationkey)""",
)
def _(spark, sf):
    return first_with_alternatives(table(spark, sf, "supplier"), "s_nationkey", "s_name", ["s_acctbal", "s_name"])


@query(
    "s5_folder",
    """SELECT 'head' AS ref, 'nation=' || c_nationkey AS folder, count(*) AS n, min(c_name) AS first, max(c_name) AS last
    FROM customer GROUP BY c_nationkey""",
)
def _(spark, sf):
    folder = f"{checkpoint_root(spark)}/snapshot-{uuid.uuid4().hex}"
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("value"))
    rows.write.partitionBy("nation").text(folder)
    files = load_snapshots(spark, folder, "head")
    lines = files.select("ref", F.substring_index("path", "/", 1).alias("folder"), F.explode(F.split(F.rtrim("content", F.lit("\n")), "\n")).alias("line"))
    return lines.groupBy("ref", "folder").agg(F.count("*").alias("n"), F.min("line").alias("first"), F.max("line").alias("last"))
