"""The manifest against trees built plainly on the driver."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from changelens.llm import merkle
from changelens.llm.common import fold

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def fold_run(run, at, inner):
    return sha("".join(inner if i == at else h for i, h in enumerate(run)))


def climb(levels, number, digest):
    """Siblings and the folded digest from a leaf of a tree to its root."""
    siblings = ""
    for level in levels[:-1]:
        run, at = level[number // 16 * 16 : number // 16 * 16 + 16], number % 16
        siblings += "".join(h for i, h in enumerate(run) if i != at)
        digest, number = fold_run(run, at, digest), number // 16
    return siblings, digest


def tree(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def brute(rows):
    """rows: dicts of COLUMNS."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by_source = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append((leaf([r[c] for c in COLUMNS]), r))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for rs in by_source.values():
        rs.sort(key=lambda x: (x[1]["doc_id"] is not None, x[1]["doc_id"] or 0, x[0]))
    trees = {s: tree([h for h, _ in by_source[s]]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    found = []
    for t, s in enumerate(names):
        for i, (own, r) in enumerate(by_source[s]):
            start, text = own, r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                start = leaf([text.translate(lower) if c == "text" else r[c] for c in COLUMNS])
            a, folded = climb(trees[s], i, start)
            b, folded = climb(top, t, folded)
            root = top[-1][0]
            found.append((r["doc_id"], own, trees[s][-1][0], root, sha(a + b), folded, folded == root))
    return sorted(found, key=str)


def made(docs):
    rows = merkle.manifest(docs, tampering=(fold(docs["doc_id"]) == 0, {"text": merkle.tampered(docs["text"])}))
    assert rows.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, rows.collect()), key=str)


def want(docs):
    return brute([r.asDict() for r in docs.select(*COLUMNS).collect()])


@pytest.mark.parametrize("sizes", [{"a": 300, "b": 17, None: 16, "c": 1, "-": 1, "": 33}, {"a": 1}, {"a": 16}, {f"s{i:03}": 1 + i % 2 for i in range(40)}])
def test_against_brute_force(make, sizes):
    rows, n = [], 0
    for source, size in sizes.items():
        for _ in range(size):
            rows.append(((n * 7919) % 10_007, f"Some Text ÄÖ {n}" if n % 3 else "plain text", source))
            n += 1
    docs = make(rows)
    got = made(docs)
    assert got == want(docs)
    assert len(got) == n and (len(got) < 20 or {r[-1] for r in got} == {True, False})


def test_odd_rows(odd, empty):
    got = made(odd)
    assert got == want(odd) and len(got) == odd.count()
    assert made(empty) == []


def test_many_equal_rows_are_numbered_in_pieces(spark, make):
    docs = make([(1, "copy", "a")] * 500 + [(i, "own", "a") for i in range(2, 40)])
    assert made(docs) == want(docs)


def test_the_row_limit_is_put_back(spark, make):
    before = spark.conf.get(merkle.ROW_LIMIT)
    made(make([(i, "x", "a") for i in range(40)]))
    assert spark.conf.get(merkle.ROW_LIMIT) == before


def test_other_columns_and_any_change(make):
    docs = make([(i, f"text {i}", "a") for i in range(20)])
    rows = merkle.manifest(docs, columns=("doc_id", "text"), tampering=(F.col("doc_id") == 3, {"text": F.lit("other")}))
    assert {r["doc_id"] for r in rows.where("NOT verified").collect()} == {3}


def test_the_leaves_of_a_run_climb_as_one_row(make, monkeypatch):
    climbed = []
    monkeypatch.setattr(merkle, "_climbed", lambda *a, f=merkle._climbed: climbed.append(f(*a)) or climbed[-1])
    docs = make([(i, f"Text {i}", "a" if i < 300 else "b") for i in range(317)] + [(400, "Lone", "c")])
    assert made(docs) == want(docs)
    assert climbed[0].count() == 19 + 2 + 1
