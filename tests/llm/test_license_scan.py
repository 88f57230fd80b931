import re
import time

import pytest

from changelens.llm import license_scan as ls
from changelens.llm.queries import op1_license_scan

from .conftest import LONG, ODD

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in ls.BASE.items():
        parts = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        places += at
        labels |= {label} if at else set()
    first, last = (min(places), max(places)) if places else (None, None)
    return len(words), len(places), first, last, ",".join(sorted(labels))


TEXTS = [
    None, "", "Licensed under CC BY-NC 4.0.", "Under the\nMIT-License, under the mit license", "apache license, version 2.0",
    "apache licenses version 2", "under the MIT licensé", "cc by nc cc by nc by nc", "Ünder the mit license under the mit license", LONG,
    "x" * 9 + " under the mit license " * 3_000, "UNDER\x00THE\tMIT\x7fLICENSE",
]


def test_base_columns():
    for text in TEXTS:
        assert ls.scan(text)[:5] == brute(text)


def test_table_against_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").collect()}
    rows = op1_license_scan(spark, "/root/testdata/sf0.1").collect()
    assert len(rows) == len(texts) and sum(r["n_base"] for r in rows) > 100
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(texts[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1


@pytest.mark.parametrize(
    "text,order",
    [
        ("MIT", "mit"),
        ("MIT OR Apache-2.0 AND BSD", "mit apache-2.0 bsd and or"),
        ("(MIT or Apache-2.0) and BSD", "mit apache-2.0 or bsd and"),
        ("GPL-2.0 WITH Classpath AND MIT", "gpl-2.0 classpath with mit and"),
        ("a or b or c", "a b or c or"),
    ],
)
def test_postfix(text, order):
    assert " ".join(ls.postfix(text)) == order


@pytest.mark.parametrize("text", ["", "MIT OR", "OR MIT", "(MIT", "MIT)", "MIT Apache", "()", "MIT (BSD)", "a and or b"])
def test_broken_expressions(text):
    with pytest.raises(ls.BrokenExpression):
        ls.postfix(text)


def test_random_expressions_against_python():
    import random

    rng = random.Random(1)
    values = {"mit": 2, "gpl-3": 1, "proprietary": 0}

    def make(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(list(values))
        return f"({make(depth - 1)} {rng.choice(['or', 'and'])} {make(depth - 1)})"

    for _ in range(200):
        text = make(4)
        python = re.sub(r"[a-z]+-?3?", lambda m: {"or": "|", "and": "&"}.get(m[0], f"V({values.get(m[0])})"), text)

        class V(int):
            __or__ = max
            __and__ = min

        V.__or__ = lambda a, b: V(max(int(a), int(b)))
        V.__and__ = lambda a, b: V(min(int(a), int(b)))
        assert ls.evaluate(ls.postfix(text))[0] == int(eval(python))


def test_tags_and_notices():
    found = ls.scan("# SPDX-License-Identifier: MIT OR GPL-2.0-only\nprint(1)")
    assert found[5] == "gpl-2,mit" and found[6] == 1.0 and found[7] == ["MIT OR GPL-2.0-only"] and found[8] == "permissive"
    assert ls.scan("<!-- spdx-license-identifier: GPL-3.0-or-later -->")[5:] == ("gpl-3", 1.0, ["GPL-3.0-or-later"], "copyleft")
    assert ls.scan("SPDX-License-Identifier:")[5:7] == ("", ls.SURE["broken"])
    assert ls.scan("GNU General Public License, version 3. All rights reserved.")[5] == "all-rights-reserved,gpl-3"


def test_odd_rows(odd, empty):
    rows = ls.license_scan(odd).collect()
    assert sorted(r["n_words"] for r in rows) == sorted(brute(t)[0] for _, t in ODD)
    assert ls.license_scan(empty).count() == 0


def test_tags_end_where_the_next_begins():
    assert ls.scan("SPDX-License-Identifier: MIT SPDX-License-Identifier: (BSD OR ISC) */ code\nGPL")[5:8] == ("bsd,isc,mit", 1.0, ["MIT", "(BSD OR ISC)"])
    broken = ls.scan("SPDX-License-Identifier: (" * 40)
    assert broken[5:7] == ("", ls.SURE["broken"])


def test_commas_are_no_names():
    assert ls.scan("SPDX-License-Identifier: MIT,Apache-2.0")[5:7] == ("apache-2", ls.SURE["notice"])  # the name is a notice of its own
    assert ls.scan("SPDX-License-Identifier: MIT,")[5:7] == ("mit", 1.0)


@pytest.mark.parametrize("text,label", [("MIT License\n\nCopyright", "mit"), ("licensed under GPLv3", "gpl-3"), ("GPL-3.0-or-later", "gpl-3"), ("Apache License", "apache")])
def test_common_headings(text, label):
    assert ls.scan(text)[5] == label


def test_an_exception_does_not_free_the_text():
    assert ls.scan("SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0")[8] == "copyleft"


def test_a_line_of_many_tags_takes_time_in_proportion():
    def seconds(n):
        text = "SPDX-License-Identifier: (" * n
        start = time.perf_counter()
        ls.scan(text)
        return time.perf_counter() - start

    seconds(1_000)
    assert min(seconds(64_000) for _ in range(5)) < 2.5 * min(seconds(32_000) for _ in range(5))
