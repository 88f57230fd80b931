"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed greedily into the longest phrases
that occur in a language's labelled text; a language that knows the text needs few phrases. The count is divided by
the phrases per byte that other labelled text of that language needs, and the least quotient wins.

The automata work on bytes of the lower-cased text, in which every ASCII character that is no letter is a blank.
Many texts are parsed at once: their bytes are cut into streams, and each step moves all streams through all
automata by one byte, as table look-ups.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold

#: Bounds of the fit: documents drawn per language, characters used of each, bytes per automaton, and bytes that show
#: how many phrases the language's own text needs.
SAMPLE = 200
SAMPLE_CHARS = 4_000
AUTOMATON_BYTES = 40_000
OWN_BYTES = 20_000
#: Bytes of all automata together: with many languages each gets less.
ALL_BYTES = 480_000
#: Bytes that a text gives at least when all drawn texts share the bytes of an automaton.
EXCERPT = 200
#: Characters of all languages together that come to the driver: with many languages each gets less.
ALL_CHARS = 64 * SAMPLE * SAMPLE_CHARS
#: Bytes of a stream. A phrase ends at the end of its stream.
STREAM = 2_048
#: Bytes parsed at once.
BLOCK = 8 << 20
UNKNOWN = "und"

_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Model:
    """Per language: its name, the text of its automaton, and the phrases per byte of its own other text."""

    languages: tuple[tuple[str, bytes, float], ...] = ()


def prepared(text: str) -> bytes:
    return text.lower().encode().translate(_LETTERS)


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """The transitions of each state, from state 0; every walk from there spells a substring of ``text``."""
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 != length[q]:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = copy
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                q = copy
            link[new] = q
        last = new
    return moves


class Parser:
    """Phrase counts of texts against several labelled texts."""

    def __init__(self, texts: tuple[bytes, ...]) -> None:
        used = sorted(set().union(*texts)) if texts else []
        # Symbol 0 is any byte that no labelled text has; it never has a move.
        self.symbols = np.zeros(256, np.int32)
        self.symbols[used] = np.arange(1, len(used) + 1)
        width, tables, at = len(used) + 1, [], 1
        self.roots = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            moves = suffix_automaton(text)
            table = np.zeros((len(moves), width), np.int32)
            for state, out in enumerate(moves):
                if out:
                    table[state, self.symbols[list(out)]] = list(out.values())
            table[table > 0] += at  # no move leads to a first state, so 0 can stand for no move
            self.roots[i] = at
            tables.append(table)
            at += len(moves)
        # Row 0 is the state without any move, where each text starts.
        self.table = np.concatenate([np.zeros((1, width), np.int32), *tables])
        self.width = width

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Phrases per text and automaton."""
        out = np.zeros((len(texts), len(self.roots)))
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end]) <= BLOCK):
                size += len(texts[end])
                end += 1
            for part, rows in self._pieces(texts[start:end]):
                np.add.at(out, start + rows, self._count(part))
            start = end
        return out

    def _pieces(self, texts: list[bytes]):
        """Streams of the texts, some ``BLOCK`` bytes at a time, and the text that each belongs to."""
        streams, rows, size = [], [], 0
        for row, text in enumerate(texts):
            for at in range(0, len(text), STREAM):
                streams.append(text[at : at + STREAM])
                rows.append(row)
                size += len(streams[-1])
                if size >= 2 * BLOCK:
                    yield streams, np.array(rows)
                    streams, rows, size = [], [], 0
        if streams:
            yield streams, np.array(rows)

    def _count(self, streams: list[bytes]) -> np.ndarray:
        lengths = np.array([len(s) for s in streams])
        order = np.argsort(-lengths, kind="stable")
        sorted_lengths, steps, many = lengths[order], int(lengths.max()), len(self.roots)
        # One row per step, the longest streams first, so that those still running are a prefix.
        symbols = np.zeros((steps, len(streams)), np.uint8 if self.width < 256 else np.int32)
        lookup = self.symbols.astype(symbols.dtype)
        for column, i in enumerate(order):
            symbols[: lengths[i], column] = lookup[np.frombuffer(streams[i], np.uint8)]
        flat, roots = self.table.ravel(), self.table[self.roots]
        state = np.zeros((many, len(streams)), np.int32)
        phrases = np.zeros((many, len(streams)), np.int32)
        running = np.searchsorted(-sorted_lengths, -np.arange(steps), side="left")
        for step in range(steps):
            n = running[step]
            symbol = symbols[step, :n].astype(np.int64)
            to = flat.take(state[:, :n].astype(np.int64) * self.width + symbol)
            ended = to == 0
            phrases[:, :n] += ended
            # The byte that did not fit starts the next phrase; one that no phrase starts with stands alone.
            state[:, :n] = np.where(ended, roots.take(symbol, axis=1), to)
        counts = np.empty((len(streams), many))
        counts[order] = phrases.T
        return counts


@functools.lru_cache(maxsize=2)
def _parser(texts: tuple[bytes, ...]) -> Parser:
    return Parser(texts)


def excerpts(texts: list[bytes], most: int) -> bytes:
    """The starts of all texts, as long as ``most`` bytes allow: short texts whole, the others equally long."""
    room, share = most - len(texts), 0
    for i, size in enumerate(sorted(map(len, texts))):
        share = max(0, room) // (len(texts) - i)
        if size > share:
            break
        room -= size
        share = size
    share = max(share, EXCERPT)
    return b" ".join(text[:share] for text in texts)[:most]


def fit(texts: dict[str, list[str]]) -> Model:
    """A model from labelled texts, of which the bounds above say how much is used."""
    most = min(AUTOMATON_BYTES, ALL_BYTES // max(1, len(texts)))
    parts = {}
    for language in sorted(texts):
        known, own = [], []
        # Copies count once; by their hash, so that texts with equal starts do not stand together.
        distinct = {prepared(text[:SAMPLE_CHARS]) for text in texts[language]}
        for i, text in enumerate(sorted(distinct, key=lambda t: (xxhash.xxh64_intdigest(t), t))):
            (own if i % 3 == 2 else known).append(text)
        learned = excerpts(known, most)
        if learned.strip():
            parts[language] = learned, (excerpts(own, OWN_BYTES) or learned)[:OWN_BYTES]
    counts = Parser(tuple(p[0] for p in parts.values())).counts([p[1] for p in parts.values()]) if parts else []
    return Model(
        tuple((name, known, float(counts[i][i]) / len(own)) for i, (name, (known, own)) in enumerate(parts.items()))
    )


def trained(docs: DataFrame) -> Model:
    """A model from documents with text and language outside fold 0, drawn by a hash of their id.

    The rates come from the counts of all such documents; the driver gets one row per language and the drawn texts.
    """
    known = docs.where(
        F.col("text").isNotNull() & (F.col("text") != "") & F.col("lang").isNotNull() & (fold(F.col("doc_id")) != 0)
    )
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not sizes:
        return Model()
    chars = min(SAMPLE_CHARS, max(EXCERPT, ALL_CHARS // SAMPLE // len(sizes)))
    sample = min(SAMPLE, max(6, ALL_CHARS // chars // len(sizes)))
    rates = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, sample / r["n"])) for r in sizes], "known_lang string, rate double")
    drawn = F.expr("lang = known_lang") & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("rate") * (1 << 30))
    known = known.select("doc_id", "lang", "text").join(F.broadcast(rates), drawn)
    texts = defaultdict(list)
    # Of rows that share an id the least text, so that an id of very many rows brings one.
    least = known.groupBy("doc_id", "lang").agg(F.min(F.substring("text", 1, chars)).alias("text"))
    for r in least.select("lang", "text").collect():
        texts[r["lang"]].append(r["text"])
    return fit(texts)


def predict(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    """Language and score of each text; the score is 1 - best / second quotient, 1 where there is one language."""
    languages, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    rows = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if model.languages else []
    if rows:
        names, known, own = zip(*model.languages)
        counts = _parser(known).counts([prepared(texts[i]) for i in rows]) / np.array(own)
        best = counts.argmin(axis=1)
        least = np.sort(counts, axis=1)
        sure = 1 - least[:, 0] / least[:, 1] if len(names) > 1 else np.ones(len(rows))
        for i, b, s in zip(rows, best, sure):
            languages[i], scores[i] = names[b], float(s)
    return languages, scores


def predicted(text: Column, model: Model) -> Column:
    """A struct of lang_pred and score."""

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        languages, scores = predict(list(texts), model)
        return pd.DataFrame({"lang_pred": languages, "score": scores})

    return of(text)


def language_id(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score. Only the text decides.

    Texts that are NULL or have no letter are ``und`` with score 0, as all are if there was nothing to learn from.
    Of languages with equal quotients the first by name wins. A NULL id is in no fold (held_out is false); repeated
    rows get equal results; other columns may have any name; an empty table gives no rows. Texts of any length are
    parsed whole, in streams of bounded size.
    """
    rows = docs.select("doc_id", predicted(F.col("text"), model).alias("p"))
    return rows.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "p.*")
