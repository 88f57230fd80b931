"""Inexact renames against a plain greedy assignment."""

import hashlib
import random

from changelens.operators.renames import assign, similar_renames
from changelens.operators.snapshots import compare_snapshots, detect_renames


def brute(moves, base, head, common):
    """Pairs of classes of equal lines, the most similar first, then those of equal names, then by a digest of their paths."""
    classes = {"old": {}, "new": {}}
    for old, new, kind, _ in moves:
        if kind in ("delete", "add"):
            side, path = ("old", old) if kind == "delete" else ("new", new)
            lines = frozenset(x for x in ((base if side == "old" else head)[path] or "").split("\n") if x)
            if lines:
                classes[side].setdefault(lines, []).append(path)
    counts = {}
    for side in classes.values():
        for lines in side:
            for x in lines:
                counts[x] = counts.get(x, 0) + 1
    pairs = []
    for a, old in classes["old"].items():
        for b, new in classes["new"].items():
            x, y = ({line for line in s if counts[line] <= common} for s in (a, b))
            similarity = 100 if a == b else 100 * len(x & y) // max(len(x), len(y), 1)
            if similarity >= 50:
                o, n = min(old), min(new)
                tie = o.split("/")[-1] != n.split("/")[-1], hashlib.md5(f"{o}\n{n}".encode()).hexdigest()
                pairs.append((-similarity, tie, o, sorted(old), sorted(new)))
    used, renamed = set(), []
    for s, _, _, old, new in sorted(pairs):
        free = [p for p in old if ("old", p) not in used], [p for p in new if ("new", p) not in used]
        for o, n in zip(*free):
            used |= {("old", o), ("new", n)}
            renamed.append((o, n, "rename", -s))
    rest = [m for m in moves if not (m[2] == "delete" and ("old", m[0]) in used) and not (m[2] == "add" and ("new", m[1]) in used)]
    return sorted(renamed + rest, key=str)


def check(spark, base, head, common=1000, hot_rows=1_000_000):
    frames = [spark.createDataFrame(list(x.items()), "path string, content string") for x in (base, head)]
    moves = [tuple(r) for r in detect_renames(compare_snapshots(*frames, ["path"], "content")).collect()]
    got = sorted((tuple(r) for r in similar_renames(*frames, common=common, hot_rows=hot_rows).collect()), key=str)
    assert got == brute(moves, base, head, common)
    return got


def text(rng, words):
    return "\n".join(rng.choice(words) for _ in range(rng.randint(0, 7)))


def test_against_greedy(spark):
    rng = random.Random(7)
    words = [f"line {i}" for i in range(12)] + [""]
    base = {f"b{i:02}": text(rng, words) for i in range(50)}
    head = {f"h{i:02}": text(rng, words) for i in range(50)} | {"b01": base["b01"], "b02": "changed"}
    got = check(spark, base, head)
    assert len({r[3] for r in got if r[2] == "rename"}) > 3


def test_groups_of_copies_are_paired_once_each(spark):
    body = "\n".join(f"shared {i}" for i in range(9))
    base = {f"old/{i:02}": body + "\n\n" for i in range(20)} | {f"old/x{i}": body + f"\nmore {i}" for i in range(3)}
    head = {f"new/{i:02}": "\n" + body for i in range(12)} | {f"new/y{i:02}": body + "\nlast" for i in range(15)}
    got = check(spark, base, head, hot_rows=4)
    assert sum(r[2] == "rename" for r in got) == 23 and sum(r[2] == "add" for r in got) == 4


def test_a_line_of_all_files_makes_no_pairs(spark):
    base = {f"old/{i:02}": f"header\nown {i}" for i in range(30)}
    head = {f"new/{i:02}": f"header\nother {i}" for i in range(30)} | {"new/moved": "header\nown 3\nheader"}
    assert sum(r[2] == "rename" for r in check(spark, base, head, common=40)) == 1
    assert sum(r[2] == "rename" for r in check(spark, base, head)) == 30  # half of two lines


def test_nothing_to_pair(spark):
    assert check(spark, {}, {}) == []
    assert {r[2] for r in check(spark, {"a": None, "b": "", "c": "x"}, {"d": None, "e": "\n\n", "f": "y"})} <= {"add", "delete", "rename"}


def test_size_estimates_do_not_grow_with_the_rounds(spark):
    columns = ["CAST(id DIV 12 AS STRING) AS old", "CAST(id % 12 AS STRING) AS new", "90 AS similarity"]
    pairs = spark.range(144).selectExpr(*columns, "CONCAT('a/', id DIV 12) AS old_first", "CONCAT('b/', id % 12, 'x') AS new_first", "1L AS old_left", "1L AS new_left")
    taken = assign(pairs)
    assert taken.count() == 12
    assert taken._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 64
