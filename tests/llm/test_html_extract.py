import html
import itertools
import re
import time

import numpy as np
import pytest
from pyspark.sql import types as T

from changelens.llm import html_extract as he
from changelens.llm.queries import op5_html_extract


@pytest.fixture(scope="module")
def field():
    return he.trained()


def of_article(page):
    """The text of the one article of a page of the given table."""
    inside = re.sub(r"</?(?:h1|p)>", "\x01", page.split("<article>")[1].split("</article>")[0])
    parts = (" ".join(html.unescape(x).split()) for x in re.sub(r"<[^>]+>", " ", inside).split("\x01"))
    return "\n\n".join(x for x in parts if x)


def test_table(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    rows = op5_html_extract(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(pages)
    assert all(r["text"] == of_article(pages[r["page_id"]]) and r["n_chars"] == len(r["text"]) for r in rows)


def test_held_out_layouts(field):
    right = total = 0
    for page in he.labelled_pages(120, seed=1234):
        found = [b for b in he.blocks(page) if b.label is not None]
        labels = field.decode(he.features(found))
        right, total = right + sum(b.label == x for b, x in zip(found, labels)), total + len(found)
    assert right / total > 0.995


def test_a_page_with_all_kinds_of_rest(field):
    page = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body>
    <header><h2>Site name</h2></header><div class="cookie-banner"><p>We use cookies. Please accept them.</p></div>
    <nav><a href=/>Start</a> <a href=/n>News</a></nav><aside class=sidebar><p>Most read. It is all here.</p></aside>
    <article><h1>A &amp; B</h1><p>First  text,\n over&nbsp;two lines.<p>Second <b>bold</b> text<br>goes on &lt;here&gt;.
    <div class="ad">Buy this now. It is cheap.</div><p>Third text ends it.</p>
    <section class="comments"><h2>Comments</h2><div class="comment"><p>I like it. Very nice.</p></div></section></article>
    <form><p>Sign up for letters.</p><input type=text><button>Go</button></form><style>p{}</style>
    <footer>&copy; 2024 us. All rights.</footer></body>"""
    assert he.main_text(page, field) == "A & B\n\nFirst text, over two lines.\n\nSecond bold text goes on <here>.\n\nThird text ends it."


@pytest.mark.parametrize("page,text", [
    ("<div>One sentence is here. And another.</div><div>Two follows it at once.</div>", "One sentence is here. And another.\n\nTwo follows it at once."),
    ("<html><body><div><div>One sentence is here. And another.</div><div>Two follows it at once.</div></div></body></html>", "One sentence is here. And another.\n\nTwo follows it at once."),
    ("<div class=text>One.<br><br>Two.</div>", "One. Two."),
    ("".join(f"<p>Paragraph number {i} of this text.</p>" for i in range(5)), "\n\n".join(f"Paragraph number {i} of this text." for i in range(5))),
    ("<table><tr><td><a href=x>Start</a> <a href=y>News</a></td></tr><tr><td>The text of the page is here. It goes on.</td></tr></table>", "The text of the page is here. It goes on."),
    ("<article><p>First text.</p><canvas><p>Second text follows.</p><object data=x><p>Third text ends.</p></article>", "First text.\n\nSecond text follows.\n\nThird text ends."),
    ("<article><p>Where <math><mi>x</mi></math> is the value.</p><svg><text>no</text></svg><p>Second text ends.</p></article>", "Where x is the value.\n\nSecond text ends."),
])
def test_plain_layouts_and_open_elements(field, page, text):
    assert he.main_text(page, field) == text


def test_held_out_plain_layouts(field, monkeypatch):
    monkeypatch.setattr(he, "PLAIN", 1.0)
    right = total = 0
    for page in he.labelled_pages(150, seed=99):
        found = [b for b in he.blocks(page) if b.label is not None]
        labels = field.decode(he.features(found))
        right, total = right + sum(b.label == x for b, x in zip(found, labels)), total + len(found)
    assert right / total > 0.97


@pytest.mark.parametrize("piece", ["<div>x ", "<a ", "<h1>", "<b>y<p>", "<canvas>", "<![CDATA[ x>", "<div class=c>z", "<!-- "])
def test_time_and_memory_in_proportion(field, piece):
    def seconds(n):
        start = time.perf_counter()
        he.main_text(piece * n, field)
        return time.perf_counter() - start

    assert min(seconds(20_000) for _ in range(3)) < 3 * max(0.02, min(seconds(10_000) for _ in range(3)))


def test_viterbi_finds_the_best_sequence():
    rng = np.random.default_rng(1)
    for _ in range(50):
        names = [f"f{i}" for i in range(6)]
        field = he.Field({n: tuple(rng.normal(size=2)) for n in names}, tuple(map(tuple, rng.normal(size=(2, 2)))))
        observed = [list(rng.choice(names, 2)) for _ in range(rng.integers(1, 7))]
        scores = field.scores(observed)

        def value(labels):
            return sum(scores[i][x] for i, x in enumerate(labels)) + sum(field.steps[a][b] for a, b in zip(labels, labels[1:]))

        best = max(itertools.product((0, 1), repeat=len(observed)), key=value)
        assert value(field.decode(observed)) == pytest.approx(value(best))


def test_training_fits_transitions():
    pages = [([["x"]] * 6, [0, 0, 0, 1, 1, 1]), ([["y"], ["x"], ["x"]], [1, 1, 1])] * 20
    field = he.train(pages, passes=30)
    assert field.decode([["y"], ["x"], ["x"], ["x"]]) == [1, 1, 1, 1]


BROKEN = [None, "", "no markup at all", "<", "<p", "<<p>>", "</p></div>", "<p class='x>text</p>", "<!-- open", "<script>never closed", "<p>&#xD800;&bogus;&amp", "<div>" * 3_000 + "deep", "<p>" + "long " * 60_000]


def test_broken_pages(spark, field):
    schema = T.StructType([T.StructField(n, t) for n, t in (("page_id", T.LongType()), ("url", T.StringType()), ("html", T.StringType()), ("text", T.StringType()), ("n_chars", T.StringType()))])
    rows = [(i if i else None, None, page, "a", "b") for i, page in enumerate(BROKEN)]
    out = he.extract_pages(spark.createDataFrame(rows + rows[:3], schema), field)
    assert out.columns == ["page_id", "url", "text", "n_chars"] and out.count() == len(BROKEN) + 3
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
    assert he.extract_pages(spark.createDataFrame([], schema), field).count() == 0
