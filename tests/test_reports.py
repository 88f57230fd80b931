"""Configurations, the whole pipeline, sinks and plan shapes."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from changelens.functions.artifacts import artifact, or_empty
from changelens.plans import extractors
from changelens.plans import reports as R
from changelens.plans.extractors import extract
from changelens.plans.reports import Rule, load_rules, run_rules
from changelens.queries import catalog, joins, reporting
from changelens.sources.rules import config_document
from changelens.sources.sinks import reports_json, write_json, write_text
from changelens.sources.snapshots import load_snapshots

SF_DIR = "/root/testdata/sf0.001"

CONFIG = {
    "concerns": {
        "security": {
            "signals": [
                {
                    "watch": {"include": "package.json", "type": "jq", "query": ".dependencies"},
                    "report": {"type": "handlebars", "template": "deps\n{{diffText}}"},
                    "notify": {"github": "@sec"},
                },
                {"use": "#defined/signals/image"},
            ]
        },
        "api": {
            "signals": [
                {
                    "watch": {"use": "#defined/watches/functions"},
                    "report": {"use": "#defined/reports/short"},
                },
                {
                    "watch": {
                        "include": ["**/*.ts", "!**/*"], "type": "ast-grep", "language": "typescript",
                        "pattern": {"context": "class C { static limits = $LIMITS }", "selector": "LIMITS"},
                    },
                    "report": {"use": "#defined/reports/short"},
                },
                {
                    "watch": {"include": "pom.xml", "type": "xpath", "expression": "//m:version", "namespaces": {"m": "http://maven"}},
                    "report": {"use": "#defined/reports/short"},
                },
            ]
        },
    },
    "defined": {
        "signals": {
            "image": {
                "watch": {"include": "Dockerfile", "type": "regex", "pattern": "^FROM (?<image_name>.+)$"},
                "report": {"use": "#defined/reports/short"},
                "notify": {"slack": "#ops", "email": None},
            }
        },
        "watches": {"functions": {"include": "src/**/*.py", "type": "tsq", "kind": "function", "capture": "name"}},
        "reports": {"short": {"type": "handlebars", "template": "{{filePath}}: {{left.artifact}} -> {{right.artifact}}"}},
    },
}

FILES = {
    "package.json": ('{"dependencies": {"a": "1", "b": "2"}}', '{"dependencies": {"a": "1", "b": "3"}, "x": 1}'),
    "Dockerfile": ("FROM node:20\nRUN x\n", "FROM node:22\nRUN x\n"),
    "src/a/m.py": ("def one():\n    pass\n", "def one():\n    return\n\n\ndef two():\n    pass\n"),
    "src/a.ts": ("class C { static limits = X }", "class C { static limits = Y }"),
    "pom.xml": ('<p xmlns="http://maven"><version>1</version></p>', '<p xmlns="http://maven"><version>2</version></p>'),
    "README.md": ("a", "b"),
}


@pytest.fixture(scope="module")
def tables(spark):
    snaps = [(ref, p, v[i]) for p, v in FILES.items() for i, ref in enumerate(("base", "head"))]
    changes = [(i, p, p, "modify") for i, p in enumerate(FILES)]
    return (
        spark.createDataFrame(changes, "file_pos int, old_path string, new_path string, type string"),
        spark.createDataFrame(snaps, "ref string, path string, content string"),
    )


@pytest.mark.parametrize("hunks", ["one", "anchored"])
def test_whole_pipeline(spark, tables, hunks):
    rules = load_rules(spark, CONFIG)
    assert [(r.concern_id, r.signal_pos, r.watch_type) for r in rules] == [
        ("security", 0, "jq"), ("security", 1, "regex"), ("api", 0, "tsq"), ("api", 1, "ast-grep"), ("api", 2, "xpath"),
    ]
    reports = run_rules(*tables, rules, ["file_pos"], "base", "head", hunks)
    got = {r.file_name: r for r in reports.collect()}
    assert {k: v.message for k, v in got.items()} == {
        "package.json": 'deps\n@@ -1,4 +1,4 @@\n {\n   "a": "1",\n-  "b": "2"\n+  "b": "3"\n }\n',
        "Dockerfile": "Dockerfile: FROM node:20 -> FROM node:22",
        "src/a/m.py": "src/a/m.py: one -> one\n\ntwo",
        "src/a.ts": "src/a.ts: X -> Y",
        "pom.xml": "pom.xml: 1 -> 2",
    }
    assert got["Dockerfile"].notify == {"slack": "#ops"}
    assert got["Dockerfile"].diff_text == (
        "@@ -1 +1 @@\n-FROM node:20\n\\ No newline at end of file\n+FROM node:22\n\\ No newline at end of file\n"
    )
    assert json.loads(got["Dockerfile"].context) == [[{"image_name": "node:20"}], [{"image_name": "node:22"}]]
    assert got["package.json"].context is None and got["package.json"].line_start is None
    assert (got["src/a/m.py"].line_start, got["src/a/m.py"].line_end) == (1, 3)


def test_json_sink_leaves_out_absent_fields(spark, tables):
    reports = run_rules(*tables, load_rules(spark, CONFIG), ["file_pos"], "base", "head")
    got = {r.file_pos: json.loads(r.json)["reports"] for r in reports_json(reports, ["file_pos"]).collect()}
    assert set(got[0][0]) == {"diffText", "fileName", "message"}
    assert list(got[1][0]) == ["diffText", "fileName", "message", "lineRange", "context"]


def test_file_sinks(spark, tables, tmp_path):
    reports = run_rules(*tables, load_rules(spark, CONFIG), ["file_pos"], "base", "head")
    write_json(reports, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 5
    write_text(reports, ["file_pos"], str(tmp_path / "text"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "text").glob("part-*")))
    assert text.startswith("deps\n") and text.index("Dockerfile:") < text.index("src/a/m.py:") < text.index("pom.xml:")


def test_rules_beyond_one_plan(spark, tables, monkeypatch):
    rules = load_rules(spark, CONFIG)
    whole = run_rules(*tables, rules, ["file_pos"], "base", "head")
    monkeypatch.setattr(R, "RULES_PER_PLAN", 2)
    pieces = run_rules(*tables, rules, ["file_pos"], "base", "head")
    assert sorted(r.message for r in pieces.collect()) == sorted(r.message for r in whole.collect())


def test_config_files(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(CONFIG))
    from_dict = load_rules(spark, CONFIG)
    assert load_rules(spark, str(tmp_path / "c.json")) == from_dict
    yaml = pytest.importorskip("yaml")
    (tmp_path / "c.yml").write_text(yaml.safe_dump(CONFIG, sort_keys=False))
    assert load_rules(spark, str(tmp_path / "c.yml")) == from_dict
    with pytest.raises(ValueError, match="concerns"):
        config_document({})


@pytest.mark.parametrize(
    ("use", "message"),
    [("#defined/watches/none", "Not found in definitions"), ("#defined/reports/short", "Expected a reference to watches"), ("bad", "Invalid reference")],
)
def test_wrong_references_fail(spark, use, message):
    config = json.loads(json.dumps(CONFIG))
    config["concerns"]["api"]["signals"][0]["watch"]["use"] = use
    with pytest.raises(Exception, match=message):
        load_rules(spark, config)


def test_unknown_types_fail():
    with pytest.raises(ValueError, match="Unsupported watch type"):
        extract("nope", F.lit(""), F.lit(""), {})
    with pytest.raises(ValueError, match="Unsupported report type"):
        R.render_report("nope", "", {})
    with pytest.raises(ValueError, match="needs a language"):
        extract("ast-grep", F.lit(""), F.lit(""), {"pattern": "a"})


def test_folder_snapshots(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "x+y.txt").write_text("one\ntwo\n")
    (tmp_path / "z.txt").write_text("é")
    got = {(r.ref, r.path): r.content for r in load_snapshots(spark, str(tmp_path), "work").collect()}
    assert got == {("work", "a b/x+y.txt"): "one\ntwo\n", ("work", "z.txt"): "é"}


def test_order(spark):
    got = [tuple(r) for r in entry.queries()["o1_order_reports"](spark, SF_DIR).select("path", "concern_pos", "signal_pos").collect()]
    assert got == sorted(got) and got


# --- plan shapes -------------------------------------------------------------------------------------------


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_only_multi_hunk_diffs_and_code_rules_use_python(spark):
    for name, build in catalog.QUERIES.items():
        # Documents that repeat a JSON key are the one other use; no other JSON query may have it.
        if name == "k1_repeated_keys":
            continue
        # The last ones sort what they have written down, so their plan shows nothing of it.
        if name.startswith(("l5_", "r5_anchored", "c1_", "c2_", "c3_", "p8_", "r5_all", "o1_", "s8_")):
            continue
        assert "Python" not in plan(build(spark, SF_DIR)), name


def test_multi_hunk_diffs_do_not_shuffle(spark):
    from changelens.operators.linediff import anchored_diff

    pairs = spark.range(10).selectExpr("id", "cast(id as string) AS l", "'x' AS r")
    text = plan(anchored_diff(pairs, ["id"], "l", "r"))
    assert "ArrowEvalPython" in text and "Exchange" not in text


def test_matching_rules_joins_nothing(spark):
    changes = spark.range(10).selectExpr("concat('src/', id) AS new_path", "'' AS old_path")
    text = plan(R.match_rules(changes, joins.PATH_RULES))
    assert "Join" not in text and "Exchange" not in text


def test_extraction_runs_once_per_row(spark):
    rules = [Rule("c", 0, 0, ("**",), "regex", {"pattern": "needle[0-9]"})]
    versions = spark.createDataFrame([("a", "a", "x", "y")], "new_path string, old_path string, old_content string, new_content string")
    text = plan(R.apply_watches(versions, rules, ["new_path"]))
    assert text.count("needle[0-9], 0") == 2  # one for each side


def test_paths_are_tested_once_for_all_rules(spark):
    versions = spark.createDataFrame([("a.xml", "a.xml", "<a/>", "<b/>")], "old_path string, new_path string, old_content string, new_content string")
    rules = [Rule("c", 0, i, ("*.xml",), kind, params) for i, (kind, params) in enumerate([("xpath", {"expression": "name(/*)"}), ("regex", {"pattern": "b"})])]
    found = R.apply_watches(versions, rules, ["new_path"])
    assert plan(found).count("RLIKE") == 1
    assert [(r.rule_no, r.left_artifact, r.right_artifact) for r in sorted(found.collect())] == [(0, "a", "b"), (1, "", "b")]


VERSIONS = "old_path string, new_path string, old_content string, new_content string"


def _refusing(*texts):
    """An extractor in Python that ends the job when it is given one of the texts."""

    @F.pandas_udf("string")
    def read(contents: pd.Series) -> pd.Series:
        if contents.isin(texts).any():
            raise ValueError("not to be read")
        return contents

    return lambda content, path, params: or_empty(artifact(read(content)), content)


def test_python_functions_get_only_what_their_rule_watches(spark, monkeypatch):
    monkeypatch.setitem(extractors.EXTRACTORS, "ast-grep", _refusing("elsewhere"))
    rows = [("a.js", "a.js", "x", "y"), ("a.md", "a.md", "elsewhere", "z"), (None, None, "elsewhere", "z")]
    found = R.apply_watches(spark.createDataFrame(rows, VERSIONS), [Rule("c", 0, 0, ("*.js",), "ast-grep")], ["new_path"])
    assert [(r.new_path, r.left_artifact, r.right_artifact) for r in found.collect()] == [("a.js", "x", "y")]


def test_moved_contents_are_not_read_again(spark, monkeypatch):
    rows = [
        ("a.js", "b.js", "moved", "moved"), ("c.js", "c.js", "x", "y"), ("d.js", "d.js", "", ""), ("e.js", None, "x", None),
        (None, "f.js", None, "y"), ("g.js", "g.js", None, None), ("c.js", "c.js", "x", "y"), ("h.js", "h.js", "", None),
    ]
    versions, rules = spark.createDataFrame(rows, VERSIONS), [Rule("c", 0, 0, ("*.js",), "ast-grep")]
    expected = [("c.js", "x", "y"), ("c.js", "x", "y"), ("e.js", "x", ""), ("f.js", "", "y")]
    for refused in ((), ("moved",)):
        monkeypatch.setitem(extractors.EXTRACTORS, "ast-grep", _refusing(*refused))
        found = R.apply_watches(versions, rules, ["old_path"]).collect()
        assert sorted((r.file_path, r.left_artifact, r.right_artifact) for r in found) == expected


@pytest.mark.parametrize(
    ("kind", "params", "path", "message"),
    [("jq", {"query": ".a"}, "a.json", "MALFORMED"), ("tsq", {"kind": "class"}, "a.json2", "Unsupported language")],
)
def test_a_moved_content_that_cannot_be_read_still_ends_the_job(spark, kind, params, path, message):
    versions = spark.createDataFrame([("old", path, "{broken", "{broken")], VERSIONS)
    with pytest.raises(Exception, match=message):
        R.apply_watches(versions, [Rule("c", 0, 0, ("*",), kind, params)], ["new_path"]).collect()


def test_change_detection_shuffles_hashes_only(spark):
    text = plan(reporting.document_changes(spark, SF_DIR))
    after_scan = text[: text.index("sha2")]
    assert "text#" not in after_scan and "content#" not in after_scan


def test_one_ref_reads_one_ref(spark):
    snaps = spark.createDataFrame([("b", "p", "c")], "ref string, path string, content string")
    changes = spark.createDataFrame([("p", "p", "modify")], "old_path string, new_path string, type string")
    from changelens.operators.snapshots import attach_versions

    text = attach_versions(changes, snaps, "b", "h")._jdf.queryExecution().optimizedPlan().toString()
    assert "(ref#" in text and "= b)" in text and "= h)" in text


def test_few_changes_pick_their_contents_before_the_shuffle(spark, tables, monkeypatch):
    rules = load_rules(spark, CONFIG)
    few = run_rules(*tables, rules, ["file_pos"], "base", "head")
    assert "LeftSemi" in plan(few)
    monkeypatch.setattr(R, "MAX_BROADCAST_BYTES", 2)
    many = run_rules(*tables, rules, ["file_pos"], "base", "head")
    assert "LeftSemi" not in plan(many)
    by_column = run_rules(*tables, rules, ["file_pos"], F.lit("base"), F.concat(F.lit("he"), F.lit("ad")))
    for other in (many, by_column):
        assert sorted(r.message for r in other.collect()) == sorted(r.message for r in few.collect())
