"""Licence scan: an Aho-Corasick automaton finds identifier tags and notice phrases, a shunting-yard parser reads tags.

A text becomes its words (runs of ASCII letters and digits, lower-cased, and of anything beyond ASCII), joined and
surrounded by single blanks; so are the phrases, and the automaton then finds phrases as whole words in one pass.
Where it finds the words of a licence tag, the rest of that line in the original text is read as an expression
with AND, OR, WITH and brackets, put into postfix order by operator precedence, and evaluated.
"""

from __future__ import annotations

import functools
import re

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base phrases with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notice phrases with their labels. One that is part of a longer phrase at its place is left out.
NOTICES = {
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd-2",
    "bsd 3 clause": "bsd-3",
    "isc license": "isc",
    "boost software license": "boost",
    "the unlicense": "unlicense",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "cc0 1 0": "cc0",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "public domain dedication": "public-domain",
    "mit license": "mit",
    "the mit license": "mit",
    "apache license": "apache",
    "apache license 2 0": "apache-2",
    "apache license version 2 0": "apache-2",
    "apache 2 0": "apache-2",
    "gnu gpl": "gpl",
    "gpl license": "gpl",
    "gplv2": "gpl-2",
    "gplv3": "gpl-3",
    "gpl 2 0": "gpl-2",
    "gpl 3 0": "gpl-3",
    "gpl v2": "gpl-2",
    "gpl v3": "gpl-3",
    "lgplv2": "lgpl-2",
    "lgplv3": "lgpl-3",
    "lgpl 2 1": "lgpl-2.1",
    "lgpl 3 0": "lgpl-3",
    "agplv3": "agpl-3",
    "agpl 3 0": "agpl-3",
    "mpl 2 0": "mpl-2",
    "epl 2 0": "epl-2",
    "bsd 2 clause license": "bsd-2",
    "bsd 3 clause license": "bsd-3",
    "isc licensed": "isc",
    "mit licensed": "mit",
    "all rights reserved": "all-rights-reserved",
}
TAGS = ("spdx license identifier",)

#: Families of labels by how freely a text may be used again; the longest fitting start of a label decides.
USE = {
    "all-rights-reserved": 0, "proprietary": 0, "cc-by-nc": 0, "cc-by-nd": 0, "gpl": 1, "agpl": 1, "lgpl": 1,
    "mpl": 1, "epl": 1, "cc-by-sa": 1, "mit": 2, "apache": 2, "bsd": 2, "isc": 2, "boost": 2, "bsl": 2, "unlicense": 2,
    "cc0": 2, "cc-by": 2, "public-domain": 2, "zlib": 2, "0bsd": 2, "python": 2,
}
VERDICTS = ("restricted", "copyleft", "permissive")
#: How sure a finding is: a tag that parses, a base phrase, another notice, a tag that does not parse.
SURE = {"tag": 1.0, "base": 0.9, "notice": 0.7, "broken": 0.4}

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TOKEN = re.compile(r"[(),]|[^\s(),]+")
_STRIP = "\"'`;,.<>*/#-\t "
_BINDS = {"or": 1, "and": 2, "with": 3}

SCHEMA = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string,"
    " score double, expressions array<string>, verdict string"
)


_NAMES = [column.split()[0] for column in SCHEMA.split(", ")]


class BrokenExpression(ValueError):
    """The text of a tag is no licence expression."""


def postfix(text: str) -> list[str]:
    """A licence expression in postfix order: WITH binds before AND, AND before OR; words are case-blind."""
    out, waiting, operand_next = [], [], True
    for token in _TOKEN.findall(text.lower()):
        if token == "(":
            if not operand_next:
                raise BrokenExpression(text)
            waiting.append(token)
        elif token == ",":  # no part of a name, and no operator
            raise BrokenExpression(text)
        elif token == ")" or token in _BINDS:
            if operand_next:
                raise BrokenExpression(text)
            least = 0 if token == ")" else _BINDS[token]
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= least:
                out.append(waiting.pop())
            if token == ")":
                if not waiting:
                    raise BrokenExpression(text)
                waiting.pop()
            else:
                waiting.append(token)
                operand_next = True
        else:
            if not operand_next:
                raise BrokenExpression(text)
            out.append(token)
            operand_next = False
    if operand_next or "(" in waiting:
        raise BrokenExpression(text)
    return out + waiting[::-1]


@functools.lru_cache(maxsize=4096)
def use_of(label: str) -> int:
    """0 restricted, 1 copyleft, 2 permissive; what is not known is restricted."""
    fits = [start for start in USE if label == start or label.startswith(start + "-")]
    return USE[max(fits, key=len)] if fits else 0


def evaluate(postfixed: list[str]) -> tuple[int, set[str]]:
    """The use an expression allows, and the licences it names.

    OR leaves the choice, so the freer side counts; AND binds to both, so the stricter one. What an exception (WITH) allows,
    such as linking, does not take the licence from the text itself.
    """
    stack: list[tuple[int, set[str]]] = []
    for token in postfixed:
        if token in _BINDS:
            (right, names), (left, more) = stack.pop(), stack.pop()
            use = {"or": max(left, right), "and": min(left, right), "with": left}[token]
            stack.append((use, more if token == "with" else more | names))
        else:
            name = token.rstrip("+").removesuffix("-only").removesuffix("-or-later").removesuffix(".0")
            stack.append((use_of(name), {name}))
    return stack[0]


@functools.lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    """Phrases between blanks; the values are (kind, label, blanks inside the phrase)."""
    found = ahocorasick.Automaton()
    for kind, phrases in (("notice", NOTICES), ("tag", dict.fromkeys(TAGS, "")), ("base", BASE)):
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (kind, label, len(phrase) + 2))
    found.make_automaton()
    return found


def _tags(text: str, words: dict[int, int]) -> dict[int, tuple[str, int]]:
    """What follows each tag (its last word, from 0, and its first) up to the next tag or the end of its line, without
    the ends of comments, and its last word. Each part of a line is read once, however many tags the line has."""
    lowered, out, firsts = text.encode().lower().decode(), {}, set(words.values())  # ASCII only, so places stay
    last, start = None, 0

    def close(end: int) -> None:
        stop = text.find("\n", start, end)
        line = text[start : end if stop < 0 else stop].lstrip(": \t")
        line = line.split("*/")[0].split("-->")[0]
        out[last] = line.strip(_STRIP), last + len(_WORD.findall(line.lower()))

    for at, match in enumerate(_WORD.finditer(lowered)):
        if at in firsts and last is not None:
            close(match.start())
            last = None
        if at in words:
            last, start = at, match.end()
    if last is not None:
        close(len(text))
    return out


def _places(line: str) -> list[tuple[int, int, str, str]]:
    """(first word, last word, kind, label) of the phrases by place; notices inside longer phrases are left out."""
    found = sorted((end - size + 1, -end, kind, label) for end, (kind, label, size) in _automaton().iter(line))
    out, word, at, reach = [], 0, 0, -1
    for start, end, kind, label in found:
        word, at = word + line.count(" ", at, start), start
        if kind != "notice" or -end > reach:
            out.append((word, word + line.count(" ", start, -end) - 1, kind, label))
        reach = max(reach, -end)
    return out


def scan(text: str | None) -> tuple:
    """The columns of ``SCHEMA`` for one text; NULL counts as empty."""
    text = text or ""
    words = b" ".join(text.encode().translate(_TABLE).split()).decode()
    if not words:
        return 0, 0, None, None, "", "", 0.0, [], None
    line = f" {words} "
    base, places, labels, sure, uses, expressions = set(), [], set(), 0.0, [], []
    found = _places(line)
    tags = {last: first for first, last, kind, _ in found if kind == "tag"}
    follows = _tags(text, tags) if tags else {}
    read = -1  # the last word of the expression of a tag, whose names are no notices
    for first, last, kind, label in found:
        if kind == "tag":
            expression, end = follows[last]
            try:
                use, names = evaluate(postfix(expression))
            except BrokenExpression:
                sure = max(sure, SURE["broken"])
                continue
            expressions.append(expression)
            labels |= names
            read = end
        elif kind == "notice" and first <= read:
            continue
        else:
            use = use_of(label)
            labels.add(label)
        if kind == "base":
            base.add(label)
            places.append(first)
        uses.append(use)
        sure = max(sure, SURE[kind])
    first, last = (min(places), max(places)) if places else (None, None)
    # Several notices hold together, so the strictest counts.
    verdict = VERDICTS[min(uses)] if uses else None
    count = words.count(" ") + 1
    return count, len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), sure, expressions, verdict


def scanned(text: Column) -> Column:
    """A struct with the columns of ``SCHEMA``."""

    @F.pandas_udf(SCHEMA)
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([scan(t) for t in texts], columns=_NAMES).astype({"first_word": "Int64", "last_word": "Int64"})

    return of(text)


def license_scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id and the columns of ``SCHEMA``.

    NULL and empty texts have no words, no label and score 0. All places of a phrase count, also when they share
    words. Only the id and the text are read, so other columns may have any name; ids may be NULL or repeat; an
    empty table gives no rows. A text of any length is read once.
    """
    return docs.select(id_column, scanned(F.col(text_column)).alias("found")).select(id_column, "found.*")
