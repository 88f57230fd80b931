"""Inputs that generated texts do not hold."""

import pytest
from pyspark.sql import functions as F

from changelens.functions.paths import glob_any
from changelens.functions.regex import regex_extract
from changelens.functions.template import render
from changelens.functions.xmlx import xml_extract
from changelens.plans import reports as R
from changelens.plans.reports import Rule, check_rule, run_rules
from changelens.sources.patches import diff_files, diff_hunks, diff_lines
from changelens.sources.snapshots import load_snapshots


def one(spark, column, text=""):
    return spark.createDataFrame([(text,)], "c string").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("pattern", "flags", "text", "found"),
    [("^.*$", "", "a\n", "a\n"), ("^.*$", "", "a\r\nb", "a\n\nb"), ("b$", "g", "ab\n", ""), ("^b", "g", "a\nb", ""), ("[$^]", "", "a^$", "^\n$")],
)
def test_line_edges(spark, pattern, flags, text, found):
    assert one(spark, regex_extract(F.col("c"), pattern, flags), text)["text"] == found


def test_empty_groups_stay_and_absent_ones_go(spark):
    pattern = r'(?<key>\w+)="(?<value>[^"]*)"|(?<bare>\w+)(?<sign>!?);'
    got = one(spark, regex_extract(F.col("c"), pattern), 'a="" b="c" d; e!;')
    assert got["context"] == ['[{"key":"a","value":""},{"key":"b","value":"c"},{"bare":"d","sign":""},{"bare":"e","sign":"!"}]']


XML = '<r><dep k="1"><name>n1</name><v>1</v></dep><b>x</b><dep k="2"><name>n2</name></dep><size>30</size></r>'


@pytest.mark.parametrize(
    ("expression", "text"),
    [
        ("//dep", "1\nn1\n1\n2\nn2"), ("//b | //size", "x\n30"), ("//size | //b", "x\n30"), ("//name/text()[1]", "n1\nn2"),
        ("//dep/@k", "1\n2"), ("//size > 25", "true"), ("count(//dep) > 2", "false"), ("number(//size) div 4", "7.5"),
        ("string(//b)", "x"), ("//a[", ""), ("nosuch(//a)", ""), ("'text'", "text"), ("1 + 1", "2"),
    ],
)
def test_xpath_forms(spark, expression, text):
    assert one(spark, xml_extract(F.col("c"), expression), XML)["text"] == text


DIFF = (
    'diff --git "a/caf\\303\\251 \\"x\\".txt" b/plain.txt\nsimilarity index 90%\nrename from "caf\\303\\251 \\"x\\".txt"\nrename to plain.txt\n'
    '--- "a/caf\\303\\251 \\"x\\".txt"\n+++ b/plain.txt\n@@ -1,2 +1 @@\n-a\r@@ q\n b\n-- \n2.40\n'
    "diff --git a/w.txt b/w.txt\r\nindex 1..2 100644\r\n--- a/w.txt\r\n+++ b/w.txt\r\n@@ -3 +3 @@\r\n-x\r\n+y\r\n"
)


def test_stored_diffs(spark):
    df = spark.createDataFrame([(1, DIFF)], "id int, d string")
    files = [(r.old_path, r.new_path, r.type) for r in diff_files(df, ["id"], "d").orderBy("file_no").collect()]
    assert files == [('café "x".txt', "plain.txt", "rename"), ("w.txt", "w.txt", "modify")]
    assert [(r.old_start, r.old_lines, r.new_lines) for r in diff_hunks(df, ["id"], "d").orderBy("file_no").collect()] == [(1, 2, 1), (3, 1, 1)]
    lines = diff_lines(df, ["id"], "d").orderBy("file_no", "line_no").collect()
    assert [(r.type, r.content.rstrip("\r")) for r in lines] == [("delete", "a\r@@ q"), ("normal", "b"), ("delete", "x"), ("insert", "y")]


@pytest.mark.parametrize(
    ("glob", "path", "match"),
    [
        ("v{01..03}.txt", "v02.txt", True), ("v{01..03}.txt", "v2.txt", False), ("{a..c}.txt", "b.txt", True), ("{a..e..2}.txt", "b.txt", False),
        ("{1..9..4}", "5", True), ("[[:alpha:]]1", "x1", True), ("[[:alpha:]]1", "21", False), ("[![:digit:]_]x", "ax", True), ("[]a]", "]", True), ("[a", "[a", True),
    ],
)
def test_globs(spark, glob, path, match):
    assert one(spark, glob_any(F.col("c"), [glob]), path) is match


def test_template_marks(spark):
    values = {"name": F.lit("<v>"), "filePath": F.lit("<p>")}
    assert one(spark, render("a {{~name~}} b {{&filePath}} {{{~filePath}}} {{~ filePath}}", values)) == "a<v>b <p><p>&lt;p&gt;"


def test_rules_that_cannot_run_are_named(spark):
    for watch, params, said in (("tsq", {"query": "(x) @y"}, "kind"), ("ast-grep", {"language": "go", "pattern": '{"context": "$A", "selector": "call"}'}, "call"), ("jq", {"query": ".a | reduce ."}, "reduce"), ("regex", {}, "pattern")):
        with pytest.raises(ValueError, match=f"concern 'c', signal 3: .*{said}"):
            check_rule(Rule("c", 0, 3, ("**",), watch, params))


def test_folder_named_like_a_part_of_its_path(spark, tmp_path, monkeypatch):
    folder = tmp_path / "run" / "a+b" / "run"
    folder.mkdir(parents=True)
    (folder / "y é.txt").write_text("t")
    monkeypatch.chdir(folder.parent)
    assert [r["path"] for r in load_snapshots(spark, str(folder), "x").collect()] == ["y é.txt"]
    assert [r["path"] for r in load_snapshots(spark, f"file://{folder}/", "x").collect()] == ["y é.txt"]


def test_many_rules_read_the_contents_once(spark, monkeypatch):
    changes = spark.createDataFrame([("a.txt", "a.txt", "a.txt", "modify")], "path string, old_path string, new_path string, type string")
    snapshots = spark.createDataFrame([("b", "a.txt", "old 1"), ("h", "a.txt", "new 2")], "ref string, path string, content string")
    rules = [Rule(f"c{i}", i, 0, ("**",), "regex", {"pattern": str(i % 3)}) for i in range(40)]
    whole = sorted((r.concern_id, r.message) for r in run_rules(changes, snapshots, rules, ["path"], "b", "h").collect())
    monkeypatch.setattr(R, "RULES_PER_PLAN", 16)
    pieces = run_rules(changes, snapshots, rules, ["path"], "b", "h")
    assert sorted((r.concern_id, r.message) for r in pieces.collect()) == whole and len(whole) == 26
    assert "Join" not in pieces._jdf.queryExecution().executedPlan().toString()
