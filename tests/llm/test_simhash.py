import random

import pytest
import xxhash

from changelens.llm import simhash
from changelens.llm.components import components

from .conftest import ODD


def brute_print(text):
    import re

    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [(i, brute_print(t)) for i, t in rows]
    nodes = sorted({p for _, p in prints})
    root = {p: p for p in nodes}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(nodes):
        for q in nodes[:i]:
            if (p ^ q).bit_count() <= 3:
                root[top(p)] = top(q)
    least = {}
    for i, p in prints:
        least.setdefault(top(p), []).append(i)
    return sorted((i or 0, f"{p:016x}", min((x for x in least[top(p)] if x is not None), default=None)) for i, p in prints)


def found(df):
    return sorted((r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in df.collect())


def test_odd_rows(odd, empty):
    assert found(simhash.near_duplicates(odd)) == brute(ODD)
    assert simhash.near_duplicates(empty).count() == 0
    out = simhash.without_near_duplicates(odd)
    assert out.columns == odd.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted({c for _, _, c in brute(ODD)})


def test_fingerprints():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("aAbÄ é\n\t  ") for _ in range(rng.randint(0, 60)))
        assert simhash.fingerprint(text) % (1 << 64) == brute_print(text)
    long = " ".join(str(rng.randint(0, 9_999)) for _ in range(70_000))
    assert simhash.fingerprint(long) % (1 << 64) == brute_print(long)


@pytest.mark.parametrize("hot_entry", [500, 3, 0])
def test_links_are_all_found(spark, hot_entry):
    rng = random.Random(2)
    prints = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            value = base
            for _ in range(rng.randint(0, 4)):
                value ^= 1 << rng.randint(0, 63)
            prints.add(value - (1 << 64) if value >> 63 else value)
    table = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    got = {(r["a"], r["b"]) for r in simhash.links(table, hot_entry).collect()}
    want = {(a, b) for a in prints for b in prints if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 3}
    assert got == want and want


def test_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(simhash.near_duplicates(docs)) == brute(rows)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (300, 299)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[100 + i] == 100 for i in range(50)) and got[300] == 299
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
