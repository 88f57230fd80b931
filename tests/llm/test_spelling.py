"""Words one edit apart against all pairs, and forms against a plain walk."""

import random
import re
import zlib

import pytest

from changelens.llm import spelling
from changelens.llm.spelling import Acceptor


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts, lower = {}, str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    counts = {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in counts}
    best = {w: min(vs, key=lambda v: (-counts[v], v)) for w, vs in near.items() if vs}
    forms = {w: v for w, v in best.items() if counts[v] >= 2 * counts[w]}
    found = []
    for w, n in counts.items():
        root = w
        while root in forms:
            root = forms[root]
        found.append((w, n, len(near[w]), forms.get(w), counts.get(forms.get(w)), root))
    return sorted(found)


def made(docs, **more):
    rows = spelling.spelling_variants(docs, **more)
    assert rows.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    return sorted(map(tuple, rows.collect()))


def texts(seed, letters, words, n):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(words)]
    return [(i, " ".join(rng.choices(base, weights=range(1, words + 1), k=60))) for i in range(n)]


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "aÀÿZz"])
def test_against_all_pairs(make, letters):
    rows = texts(1, letters, 250, 60)
    got = made(make(rows))
    assert got == brute(rows) and any(r[2] for r in got) and any(r[3] for r in got)


def test_small_partitions_give_the_same(make):
    rows = texts(2, "abc", 300, 60)
    got = made(make(rows), most=3)
    assert got == brute(rows) and max(r[2] for r in got) > 3


def test_chains_lead_to_the_last_form(make):
    words = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb", "abbbbb"]
    rows = [(None, " ".join(w for k, w in enumerate(words) for _ in range(3 * 2**k)))]
    assert {r[5] for r in made(make(rows))} == {"abbbbb"}
    assert made(make(rows)) == brute(rows)


def test_odd_rows(make, odd, empty):
    assert made(empty) == [] and made(make([(1, None), (2, ""), (3, "  ")])) == []
    assert made(odd) == brute([(r["doc_id"], r["text"]) for r in odd.collect()])
    long = "x" * 30_000
    rows = [(i, f"{long} {long}y z{long} Größe größe Größen CAFÉS cafés") for i in range(4)]
    assert made(make(rows)) == brute(rows)


def test_acceptor_is_minimal_and_numbers_its_words():
    words = sorted({a + b + c for a in ("", "k", "st") for b in ("or", "an") for c in ("t", "te", "d", "de")})
    acceptor = Acceptor(words)
    assert acceptor.size(acceptor.start) == len(words)
    # the endings are the same whatever goes before
    assert len(acceptor.final) <= 8
    pairs = {frozenset((words[a], words[b])) for a, b in acceptor.near(99)}
    assert pairs == {frozenset((a, b)) for a in words for b in words if a < b and one_edit(a, b)}
    assert len(list(acceptor.near(99))) == len(pairs)
