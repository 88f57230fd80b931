import re
from collections import Counter

from changelens.llm import quality_rules as qr

from .conftest import LONG, ODD

GOOD = "\n".join(" ".join(f"word{12 * i + j}" for j in range(12)).capitalize() + "." for i in range(8))


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def measured(r):
    return r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]


TEXTS = [None, "", "a", "a b", "a b c", "a b c a b c", "x x x x x", "a\n\n a\na\n", "é ü ü\té\nß", LONG, GOOD, GOOD + "\n" + GOOD, " \x0b\x0c\r\n", "w " * 49 + "é|*"]


def test_base_columns(make):
    rows = {r["doc_id"]: r for r in qr.quality_rules(make(list(enumerate(TEXTS)))).collect()}
    assert [measured(rows[i]) for i in range(len(TEXTS))] == [base(t) for t in TEXTS]


def test_lines_and_verdict(make):
    bad = {
        "symbols": "The *** of $$$ the ### and %%% more &&& words.", "shouted": "THIS IS ALL VERY LOUD AND BIG!!",
        "unended": "a line that goes on and on without any end", "phrase": "Click here to read more.",
        "repeated": "go go go go go go go go go go go go.", "pipes": "Home | News | Sport | Weather.",
    }
    rows = [(0, GOOD)] + [(i + 1, GOOD + "\n" + line) for i, line in enumerate(bad.values())] + [(9, GOOD[:300] + "\n" + "\n".join(" ".join(f"LOUD{6 * i + j}" for j in range(6)) for i in range(40)))]
    found = {r["doc_id"]: r for r in qr.quality_rules(make(rows)).collect()}
    assert found[0]["kept"] and found[0]["lost_chars"] == 0 and found[0]["cleaned"] == GOOD
    for i, line in enumerate(bad.values()):
        assert found[i + 1]["kept"] and found[i + 1]["lost_chars"] == len(line) and found[i + 1]["cleaned"] == GOOD
    assert not found[9]["kept"] and not found[9]["base_failed"]


def test_odd_rows_and_no_python(odd, empty):
    df = qr.quality_rules(odd)
    assert sorted(map(measured, df.collect())) == sorted(base(t) for _, t in ODD)
    assert qr.quality_rules(empty).count() == 0
    plan = df._jdf.queryExecution().toString()
    assert not any(p in plan for p in ("Python", "Pandas", "Arrow", "Exchange"))


def test_good_labels_are_kept(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet").where("quality IS NOT NULL"), "doc_id")
    rows = qr.quality_rules(docs).join(docs.select("doc_id", "quality"), "doc_id").where("NOT base_failed").groupBy("quality").agg({"*": "count"}).collect()
    kept = qr.quality_rules(docs).where("kept").join(docs.select("doc_id", "quality"), "doc_id").groupBy("quality").agg({"*": "count"}).collect()
    share = {r[0]: dict(kept).get(r[0], 0) / r[1] for r in rows}
    assert share[1] > 0.99 and share[0] < 0.3


def test_phrases_are_words(make):
    """By hand: what the SQL says could repeat a fault of the code."""
    kept = "They design in Berlin and we catalog in print.\nA cookie with butter.\nPlease sign-in sheets.\n" * 20
    cut = "Please sign in.\nClick here!\nWe use cookies\nread more\n" * 20
    rows = qr.quality_rules(make([(1, kept), (2, cut)])).orderBy("doc_id").collect()
    assert [r["lost_chars"] for r in rows] == [0, sum(map(len, cut.split("\n")))]
