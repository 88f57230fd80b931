"""Operators on small tables, against brute force where the result is not obvious."""

import json
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from changelens.operators.jsondiff import json_entry_diff, json_nodes
from changelens.operators.linediff import anchored_diff, line_diff, line_range, unified_text
from changelens.operators.ordered import ranked, with_earlier_max, with_previous
from changelens.operators.snapshots import (
    attach_versions,
    compare_snapshots,
    detect_renames,
    snapshot_diff,
    tree_status,
)
from changelens.operators.spans import match_spans, maximal_spans
from changelens.operators.versions import version_pairs
from changelens.sources.patches import diff_files, diff_hunks, diff_lines, hunk_counts


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- ordered computations: cutting hot keys must change nothing --------------------------------------------


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    data = [("hot", i, rng.randrange(100)) for i in range(900)]
    data += [(f"k{i % 40}", i, rng.randrange(100)) for i in range(300)] + [(None, i, i) for i in range(50)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, o int, v int")


def test_ranked_in_chunks(skewed):
    plain = skewed.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy("o")))
    for hot_rows in (20, 100, 10_000):
        assert rows(ranked(skewed, ["k"], ["o"], hot_rows=hot_rows)) == rows(plain)


def test_previous_in_chunks(skewed):
    plain = skewed.withColumn("before", F.lag("v").over(Window.partitionBy("k").orderBy("o")))
    for hot_rows in (20, 100, 10_000):
        assert rows(with_previous(skewed, ["k"], ["o"], {"v": "before"}, hot_rows)) == rows(plain)


def test_earlier_max_in_chunks(skewed):
    window = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    plain = skewed.withColumn("top", F.max("v").over(window))
    for hot_rows in (20, 100, 10_000):
        assert rows(with_earlier_max(skewed, ["k"], ["o"], "v", "top", hot_rows)) == rows(plain)


def test_version_pairs_keep_null_contents(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("a", 3, None), ("b", 1, "y")], "k string, n int, c string")
    assert rows(version_pairs(df, ["k"], ["n"], "c")) == rows(
        spark.createDataFrame([("a", 2, None, "x"), ("a", 3, "x", None)], "k string, n int, o string, c string")
    )


def test_maximal_spans_against_pairs(spark):
    rng = random.Random(3)
    spans = [(rng.choice(["hot", "hot", "x", "y"]), s, s + rng.randrange(30), i) for i in range(400) for s in [rng.randrange(300)]]
    expected = [
        c for c in spans
        if not any(o[0] == c[0] and o[1] <= c[1] and o[2] >= c[2] and (o[1] < c[1] or o[2] > c[2]) for o in spans)
    ]
    df = spark.createDataFrame(spans, "m string, s int, e int, id int")
    for hot_rows in (20, 1000):
        assert rows(maximal_spans(df, "m", "s", "e", hot_rows)) == sorted(expected, key=str)


def test_match_spans(spark):
    df = spark.createDataFrame([(1, "ab12c345"), (2, "none"), (3, "9")], "id int, t string")
    got = rows(match_spans(df, ["id"], "t", r"\d+"))
    assert got == [(1, 0, 2, 4, "12"), (1, 1, 5, 8, "345"), (3, 0, 0, 1, "9")]
    with pytest.raises(Exception, match="empty text"):
        match_spans(df, ["id"], "t", r"\d*").collect()


# --- snapshots ---------------------------------------------------------------------------------------------


def snapshot(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, content string")


def test_renames_pair_copies_in_path_order(spark):
    base = snapshot(spark, {f"old/{i}": "same" for i in range(60)} | {"keep": "kept", "mod": "1", "gone": "g"})
    head = snapshot(spark, {f"new/{i}": "same" for i in range(70)} | {"keep": "kept", "copy": "kept", "mod": "2", "fresh": "f"})
    status = compare_snapshots(base, head, ["path"], "content")
    old, new = sorted(f"old/{i}" for i in range(60)), sorted(f"new/{i}" for i in range(70))
    expected = [(o, n, "rename", 100) for o, n in zip(old, new)]
    expected += [(None, n, "add", None) for n in [*new[60:], "fresh"]]
    expected += [("keep", "copy", "copy", 100), ("mod", "mod", "modify", None), ("gone", None, "delete", None)]
    for hot_rows in (10, 1000):
        assert rows(detect_renames(status, hot_rows=hot_rows)) == sorted(expected, key=str)


def test_snapshot_diff_is_symmetric(spark):
    rng = random.Random(5)
    base = snapshot(spark, {f"p{i}": rng.choice("abc") for i in range(50)})
    head = snapshot(spark, {f"p{i}": rng.choice("abc") for i in range(25, 80)})
    there = {(r.path, r.type) for r in snapshot_diff(base, head, ["path"], "content").collect()}
    back = {(r.path, r.type) for r in snapshot_diff(head, base, ["path"], "content").collect()}
    swap = {"add": "delete", "delete": "add", "modify": "modify"}
    assert there == {(p, swap[t]) for p, t in back}


def test_attach_versions_guards_sides(spark):
    snaps = spark.createDataFrame([("b", "x", "old"), ("h", "x", "new"), ("h", "y", "moved")], "ref string, path string, content string")
    changes = spark.createDataFrame(
        [(1, "x", "x", "modify"), (2, "x", "x", "add"), (3, "x", "x", "delete"), (4, "x", "y", "rename"), (5, "q", "q", "modify")],
        "id int, old_path string, new_path string, type string",
    )
    expected = {1: ("old", "new"), 2: (None, "new"), 3: ("old", None), 4: ("old", "moved"), 5: (None, None)}
    for base, head in (("b", "h"), (F.lit("b"), F.lit("h"))):
        got = attach_versions(changes, snaps, base, head).collect()
        assert {r.id: (r.old_content, r.new_content) for r in got} == expected


def test_contents_are_never_broadcast_by_an_estimate(spark):
    paths = spark.range(20).selectExpr("id", "CONCAT('p', id) AS path")
    texts = [paths.selectExpr(f"'{ref}' AS ref", "path", f"CONCAT('{ref}', id) AS content") for ref in ("b", "h")]
    changes = paths.selectExpr("id", "path AS old_path", "path AS new_path", "'modify' AS type")
    for few in (False, True):
        got = attach_versions(changes, texts[0].unionByName(texts[1]), "b", "h", few)
        plan = got._jdf.queryExecution().executedPlan().toString()
        # Only the asked paths are sent to all tasks, where the caller says they are few.
        assert plan.count("BroadcastHashJoin") == plan.count("LeftSemi") and plan.count("SortMergeJoin") == 2
        assert {r.id: (r.old_content, r.new_content) for r in got.collect()} == {i: (f"b{i}", f"h{i}") for i in range(20)}


def test_tree_status(spark):
    def side(*files):
        return spark.createDataFrame(files, "repo string, path string, content string")

    got = tree_status(
        side(("r", "a", "1"), ("s", "a", "1"), ("t", "a", "1")),
        side(("r", "a", "1"), ("s", "a", "2"), ("t", "a", "1")),
        side(("r", "a", "1"), ("s", "a", "2"), ("t", "a", "1"), ("t", "b", "1")),
        "repo", ["path"], "content",
    )
    assert rows(got) == [("r", False, False, True), ("s", True, False, False), ("t", False, True, False)]


# --- line differences --------------------------------------------------------------------------------------


def edited_texts(n=250):
    """Pairs of texts with several separate edits, repeated lines, and every kind of ending."""
    rng = random.Random(11)
    pairs = [("", "a"), ("a", ""), ("a", "a\n"), ("a\n", "a\n\n"), ("\n", ""), ("a\nb\na\n", "a\nb\na\nb\na\n")]
    while len(pairs) < n:
        lines = [rng.choice([f"line {i}", f"line {i}", "same", ""]) for i in range(rng.randrange(60))]
        changed = list(lines)
        for _ in range(rng.randrange(1, 6)):
            at = rng.randrange(len(changed) + 1)
            changed[at : at + rng.randrange(3)] = [f"new {rng.randrange(9)}" for _ in range(rng.randrange(3))]
        pairs.append(("\n".join(lines) + rng.choice(["", "\n"]), "\n".join(changed) + rng.choice(["", "\n"])))
    return [(i, a, b) for i, (a, b) in enumerate(pairs) if a != b]


def split_lines(text):
    return text.splitlines(keepends=True)


def apply_patch(text, hunks):
    """Apply unified hunks strictly; every context and deleted line must match."""
    source, out, at = split_lines(text), [], 0
    for hunk in hunks:
        header, *body = split_lines(hunk)
        ranges = dict(zip("-+", header.split()[1:3]))
        start, _, count = ranges["-"][1:].partition(",")
        start, count = int(start), int(count or 1)
        first = start if count == 0 else start - 1
        out += source[at:first]
        at = first
        for line in body:
            if line.startswith("\\"):
                # The line before it has no newline.
                target[-1] = target[-1].rstrip("\n")
                continue
            mark, content = line[0], line[1:]
            expected = split_lines(text)[at] if mark in " -" else None
            if mark in " -":
                assert expected.rstrip("\n") == content.rstrip("\n"), (hunk, expected)
                at += 1
            target = out if mark in " +" else [content]
            if mark in " +":
                out.append(content)
    return "".join(out + source[at:])


def test_patches_give_the_new_text(spark):
    pairs = edited_texts()
    df = spark.createDataFrame(pairs, "id int, l string, r string")
    one = {r.id: r.diff_text for r in unified_text(df, ["id"], "l", "r").collect()}
    many = {}
    for r in anchored_diff(df, ["id"], "l", "r").orderBy("id", "hunk_no").collect():
        many.setdefault(r.id, []).append(r)
    assert max(map(len, many.values())) > 1
    for i, left, right in pairs:
        assert apply_patch(left, [one[i]]) == right
        assert apply_patch(left, [h.hunk_text for h in many[i]]) == right
        for h in many[i]:
            body = split_lines(h.hunk_text)[1:]
            assert sum(b[0] in " -" for b in body) == h.old_lines
            assert sum(b[0] in " +" for b in body) == h.new_lines


def test_separate_edits_are_separate_hunks(spark):
    left = [f"l{i}" for i in range(40)]
    right = ["x", *left[:20], "y", *left[21:]]
    df = spark.createDataFrame([(1, "\n".join(left), "\n".join(right))], "id int, l string, r string")
    got = [r.asDict() for r in anchored_diff(df, ["id"], "l", "r").orderBy("hunk_no").collect()]
    assert [(h["old_start"], h["old_lines"], h["new_start"], h["new_lines"]) for h in got] == [(1, 3, 1, 4), (18, 7, 19, 7)]
    assert got[1]["hunk_text"] == "@@ -18,7 +19,7 @@\n l17\n l18\n l19\n-l20\n+y\n l21\n l22\n l23\n"


def test_line_diff_is_a_multiset_difference(spark):
    from collections import Counter

    pairs = edited_texts(80)
    df = spark.createDataFrame(pairs, "id int, l string, r string")
    got = {}
    for r in line_diff(df, ["id"], "l", "r").collect():
        got.setdefault(r.id, []).append((r.op, r.line_no, r.line.split("\n")[0]))
    for i, left, right in pairs:
        ls, rs = ([s if s.endswith("\n") else s + "\\" for s in split_lines(t)] for t in (left, right))
        diff = Counter(rs)
        diff.subtract(Counter(ls))
        assert len(got[i]) == sum(map(abs, diff.values()))
        for op, n, line in got[i]:
            assert (ls if op == "-" else rs)[n - 1].rstrip("\n\\") == line


@pytest.mark.parametrize(
    ("text", "expected"),
    [("@@ -1,2 +20,5 @@\n a\n", (20, 24)), ("--- a\n+++ b\n@@ -1 +3 @@\n", (3, 3)), ("@@ -1,2 +0,0 @@\n", (0, -1)), ("none", None)],
)
def test_line_range(spark, text, expected):
    got = spark.createDataFrame([(text,)], "t string").select(line_range(F.col("t")).alias("r")).first()["r"]
    assert (tuple(got) if got else None) == expected


# --- stored diffs ------------------------------------------------------------------------------------------

PATCH = """diff --git a/pkg.json b/pkg.json
index abc1234..def5678 100644
--- a/pkg.json
+++ b/pkg.json
@@ -10,4 +10,5 @@ scope
   },
-    "old": "1"
+    "new": "2"
+    "more": "3"
   },

@@ -30 +31 @@
-x
\\ No newline at end of file
+y
diff --git a/new file.txt b/new file.txt
new file mode 100755
index 0000000..abc1234
--- /dev/null
+++ b/new file.txt
@@ -0,0 +1,2 @@
+one
+--- two
diff --git a/a.txt b/b.txt
similarity index 100%
copy from a.txt
copy to b.txt
diff --git a/m.sh b/m.sh
old mode 100644
new mode 100755
"""


def test_stored_diffs(spark):
    df = spark.createDataFrame([(1, PATCH), (2, " \n"), (3, "")], "id int, t string")
    files = {r.file_no: r for r in diff_files(df, ["id"], "t").collect()}
    assert [(f.old_path, f.new_path, f.type) for _, f in sorted(files.items())] == [
        ("pkg.json", "pkg.json", "modify"), ("/dev/null", "new file.txt", "add"), ("a.txt", "b.txt", "copy"), ("m.sh", "m.sh", "modify"),
    ]
    assert (files[0].old_rev, files[0].new_rev, files[0].old_mode) == ("abc1234", "def5678", "100644")
    assert (files[1].old_mode, files[1].new_mode) == (None, "100755")
    assert (files[2].similarity, files[3].old_mode, files[3].new_mode) == (100, "100644", "100755")
    hunks = rows(diff_hunks(df, ["id"], "t"))
    assert hunks == [(1, 0, 0, 10, 4, 10, 5, "scope"), (1, 0, 1, 30, 1, 31, 1, ""), (1, 1, 0, 0, 0, 1, 2, "")]
    lines = diff_lines(df, ["id"], "t")
    got = [tuple(r)[1:] for r in lines.where("file_no = 0").orderBy("hunk_no", "line_no").collect()]
    assert got[:5] == [
        (0, 0, 0, "normal", "  },", 10, 10), (0, 0, 1, "delete", '    "old": "1"', 11, None), (0, 0, 2, "insert", '    "new": "2"', None, 11),
        (0, 0, 3, "insert", '    "more": "3"', None, 12), (0, 0, 4, "normal", "  },", 12, 13),
    ]
    declared = {(r.id, r.file_no, r.hunk_no): (r.old_lines, r.new_lines) for r in diff_hunks(df, ["id"], "t").collect()}
    counted = {(r.id, r.file_no, r.hunk_no): (r.old_lines, r.new_lines) for r in hunk_counts(lines, ["id"]).collect()}
    assert declared == counted


# --- JSON as rows ------------------------------------------------------------------------------------------


def test_json_nodes_find_their_depth(spark):
    df = spark.createDataFrame([(1, '{"a":[{"b":null},[]],"c":"[{"}'), (2, "3"), (3, "{}")], "id int, c string")
    got = {(r.id, r.path): (r.kind, r.value) for r in json_nodes(df, ["id"], "c").collect()}
    assert got == {
        (1, "$"): ("OBJECT", None), (1, "$.a"): ("ARRAY", None), (1, "$.a[0]"): ("OBJECT", None), (1, "$.a[0].b"): ("VOID", "null"),
        (1, "$.a[1]"): ("ARRAY", None), (1, "$.c"): ("STRING", '"[{"'), (2, "$"): ("BIGINT", "3"), (3, "$"): ("OBJECT", None),
    }
    by_level = {(r.id, r.path): (r.kind, r.value) for r in json_nodes(df, ["id"], "c", levels=1).collect()}
    assert by_level == got
    deep = spark.createDataFrame([(1, "[" * 30 + "]" * 30)], "id int, c string")
    assert json_nodes(deep, ["id"], "c").count() == 30


def test_json_entry_diff(spark):
    df = spark.createDataFrame([(1, '{"a":1,"b":"x","c":[1]}', '{"b":"y","c":[1],"d":null}'), (2, None, '{"z":1}')], "id int, o string, n string")
    assert rows(json_entry_diff(df, ["id"], "o", "n")) == sorted(
        [(1, "a", "removed", "1", None), (1, "b", "changed", '"x"', '"y"'), (1, "d", "added", None, "null"), (2, "z", "added", None, "1")], key=str
    )
    assert json.loads('"y"') == "y"
