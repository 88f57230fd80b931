import random
import zlib

import pytest

from changelens.llm import language_id as li
from changelens.llm.queries import op6_language_id

from .conftest import LONG, ODD

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    truth = {r["doc_id"]: (r["lang"], len(r["text"] or "")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op6_language_id(spark, SF).collect()
    assert len(rows) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"] and truth[r["doc_id"]][1] > 20]
    assert len(held) > 1_500 and sum(r["lang_pred"] == truth[r["doc_id"]][0] for r in held) / len(held) > 0.99
    assert all(0 <= r["score"] <= 1 for r in rows)


def brute(text, known):
    """Phrases of the greedy parse, by searching the known text."""
    total = 0
    for at in range(0, len(text), li.STREAM):
        part, i = text[at : at + li.STREAM], 0
        while i < len(part):
            n = 1
            while i + n < len(part) and part[i : i + n + 1] in known:
                n += 1
            i, total = i + n, total + 1
    return total


def test_counts_by_the_definition(monkeypatch):
    monkeypatch.setattr(li, "STREAM", 50)
    monkeypatch.setattr(li, "BLOCK", 64)
    rng = random.Random(2)
    known = tuple(bytes(rng.choice(b"abc ") for _ in range(n)) for n in (1, 30, 200))
    texts = [b""] + [bytes(rng.choice(b"abcd ") for _ in range(rng.randint(0, 180))) for _ in range(60)]
    got = li.Parser(known).counts(texts)
    assert got.tolist() == [[brute(t, k) for k in known] for t in texts]


def test_automaton_has_just_the_substrings():
    rng = random.Random(3)
    text = bytes(rng.choice(b"ab") for _ in range(40))
    moves = li.suffix_automaton(text)

    def has(part):
        state = 0
        for c in part:
            if c not in moves[state]:
                return False
            state = moves[state][c]
        return True

    parts = {text[i:j] for i in range(40) for j in range(i, 41)}
    assert all(map(has, parts))
    assert all(has(p) == (p in parts) for p in (bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 12))) for _ in range(300)))


@pytest.fixture(scope="module")
def model():
    return li.fit({"en": ["the sea and the sky and the hill of the town"] * 4, "de": ["das meer und der himmel und das tal der stadt"] * 4})


def test_odd_rows(odd, empty, model):
    rows = {r["doc_id"]: r for r in li.language_id(odd, model).collect()}
    assert rows[1]["lang_pred"] == rows[2]["lang_pred"] == rows[7]["lang_pred"] == "und" and rows[1]["score"] == 0.0
    assert rows[5]["lang_pred"] == rows[6]["lang_pred"] and not rows[None]["held_out"]
    assert li.language_id(odd, model).count() == len(ODD) and li.language_id(empty, model).count() == 0


def test_predictions(model):
    names, scores = li.predict(["the town and the sea", "der himmel und das meer", "12 34 !", None, "日本", LONG], model)
    assert names[:4] == ["en", "de", "und", "und"] and names[4] in ("de", "en") and scores[0] > 0 and scores[2] == 0


def test_without_labels(odd, empty):
    assert li.trained(empty) == li.trained(odd) == li.Model()
    assert li.language_id(odd, li.Model()).where("lang_pred <> 'und'").count() == 0


def test_one_language():
    assert li.predict(["abc"], li.fit({"xx": ["abc abc"]})) == (["xx"], [1.0])


def test_copies_do_not_fill_the_automaton():
    rng = random.Random(7)
    words = {n: ["".join(rng.choice(a) for _ in range(6)) for _ in range(400)] for n, a in (("xx", "abcdef"), ("yy", "abcghi"))}
    text = {n: lambda n=n: " ".join(rng.choices(words[n], k=500)) for n in words}
    copy = "aaaa " + text["xx"]()
    drawn = {n: [text[n]() for _ in range(130)] for n in words}
    model = li.fit({"xx": [copy] * 70 + drawn["xx"], "yy": drawn["yy"]})
    learned = dict((n, known) for n, known, _ in model.languages)
    assert all(len(known) <= li.AUTOMATON_BYTES for known in learned.values())
    assert learned["xx"].count(copy[:200].encode()) <= 1
    starts = [t[:150].encode() for t in drawn["xx"]]
    assert sum(s in learned["xx"] for s in starts) > 80


def test_every_language_is_learned(spark):
    rng = random.Random(9)
    letters = [chr(0x4E00 + i) for i in range(800)]
    rows = [(70 * i + k, " ".join(rng.choices(letters[10 * i : 10 * i + 10], k=40)), f"l{i:02}") for i in range(80) for k in range(8)]
    model = li.trained(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert len(model.languages) == 80
    assert li.predict([t for _, t, _ in rows], model)[0] == [n for _, _, n in rows]


def test_labels_and_scores_by_the_definition(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model, rows = li.trained(docs), {r["doc_id"]: r["text"] for r in docs.collect()}
    few = sorted((i for i in rows if rows[i] and any(map(str.isalpha, rows[i]))), key=lambda i: (len(rows[i]), i))[:40]
    for r in li.language_id(docs.where(docs["doc_id"].isin(few)), model).collect():
        quotients = sorted((brute(li.prepared(rows[r["doc_id"]]), known) / own, at) for at, (_, known, own) in enumerate(model.languages))
        assert r["lang_pred"] == model.languages[quotients[0][1]][0]
        assert r["score"] == pytest.approx(1 - quotients[0][0] / quotients[1][0])


def test_one_row_of_an_id_is_learned_from(spark, make, monkeypatch):
    docs = make([(1, f"text {i:03}") for i in range(50)] + [(2, "two"), (3, "three"), (4, "four")])
    docs = docs.drop("lang").selectExpr("*", "'en' AS lang")
    seen = []
    monkeypatch.setattr(li, "fit", lambda texts: seen.append(dict(texts)))
    li.trained(docs)
    known = {1: "text 000", 2: "two", 3: "three", 4: "four"}
    assert sorted(seen[0]["en"]) == sorted(t for i, t in known.items() if zlib.crc32(str(i).encode()) % 5)
