"""Spelling variants: words one edit apart, by composing a vocabulary acceptor, a one-edit transducer and the acceptor.

The transducer has two states, before and after the edit. A state of the composed machine is two states of the acceptor
and one of the transducer: before the edit both words have gone the same way; the edit replaces, inserts or deletes a
letter; afterwards both must go on alike. The acceptor is minimal, so equal rests are one state and are seen at once.

The machine is worked on in partitions. A partition is the set of words that share a beginning and an end, so it starts in
the state that the beginning leads to, and accepts pairs that part within a range of places. If two words of one edit
part in the first half, they share the second, so each partition that is too large is cut in two such ways again; the
ranges of places do not overlap, so each pair is accepted once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

#: Words count from this many letters and occurrences on.
LETTERS, TIMES = 5, 3
#: A form has at least this many times the occurrences of its variant.
RATIO = 2
#: Partitions of more words are cut up further.
MOST = 4_000
#: Every run whose crc32 this number divides loses a letter.
DROPPED = 97

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RUN = r"[a-z\x{C0}-\x{FF}]+"
_FAR = 1 << 30


class Acceptor:
    """The minimal acyclic automaton of sorted distinct words. A path's offsets sum up to the number of its word."""

    def __init__(self, words: list[str], skip: int = 0):
        self.final: list[bool] = []
        self.arcs: list[dict[str, tuple[int, int]]] = []  # letter: next state, words before those behind it
        self._sizes: list[int] = []
        self._known: dict[tuple, int] = {}
        path: list[tuple[list, list]] = [([False], [])]  # whether a word ends here, arcs
        before = ""
        for word in words:
            word = word[skip:]
            same, most = 0, min(len(word), len(before))
            while same < most and word[same] == before[same]:
                same += 1
            self._close(path, before, same)
            path += [([False], []) for _ in range(len(word) - same)]
            path[-1][0][0] = True
            before = word
        self._close(path, before, 0)
        self.start = self._state(*path[0])

    def _close(self, path: list, word: str, depth: int) -> None:
        while len(path) - 1 > depth:
            state = self._state(*path.pop())
            path[-1][1].append((word[len(path) - 1], state))

    def _state(self, final: list, arcs: list) -> int:
        key = (final[0], *arcs)
        state = self._known.get(key)
        if state is None:
            state = self._known[key] = len(self.final)
            size, numbered = int(final[0]), {}
            for letter, to in arcs:
                numbered[letter] = (to, size)
                size += self._sizes[to]
            self.final.append(final[0])
            self.arcs.append(numbered)
            self._sizes.append(size)
        return state

    def size(self, state: int) -> int:
        return self._sizes[state]

    def _alike(self, x: int, i: int, y: int, j: int, without: str | None = None) -> Iterator[tuple[int, int]]:
        """Numbers of the words that go on alike from two states (after the edit), not with ``without`` at first."""
        arcs, final, sizes = self.arcs, self.final, self._sizes
        waiting = [(x, i, y, j, without)]
        while waiting:
            x, i, y, j, without = waiting.pop()
            if x == y and without is None:  # equal rests
                for k in range(sizes[x]):
                    yield i + k, j + k
                continue
            if final[x] and final[y]:
                yield i, j
            few, other = arcs[x], arcs[y]
            for letter, (to, skipped) in few.items():
                found = other.get(letter)
                if found is not None and letter != without:
                    waiting.append((to, i + skipped, found[0], j + found[1], None))

    def near(self, places: int) -> Iterator[tuple[int, int]]:
        """Numbers of all pairs of words that are one edit apart and part at one of the first ``places`` places."""
        waiting = [(self.start, 0, 0)] if places > 0 else []
        while waiting:
            state, number, place = waiting.pop()
            arcs = list(self.arcs[state].items())
            for n, (letter, (to, skipped)) in enumerate(arcs):
                for _, (other, more) in arcs[n + 1 :]:  # a letter replaced
                    yield from self._alike(to, number + skipped, other, number + more)
                # A letter more or less; where it repeats, the last place counts.
                yield from self._alike(to, number + skipped, state, number, letter)
                if place + 1 < places and (self._sizes[to] > 1 or self.final[state]):
                    waiting.append((to, number + skipped, place + 1))


def words(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """word, n: the words of the texts with their occurrences, some runs having lost a letter by their crc32."""
    text = F.translate(text_of(text_column), _UPPER, _LOWER)
    runs = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(_RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= LETTERS).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = "CAST(h % length(run) AS INT)"
    word = F.expr(f"IF(h % {DROPPED} = 0, concat(left(run, {at}), substring(run, {at} + 2)), run)")
    counts = runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where((F.length("word") >= LETTERS) & (F.col("n") >= TIMES))


def _keyed(rows: DataFrame) -> DataFrame:
    """With the key of the partition: the lengths it is for, the places, and what its words share."""
    key = F.concat_ws("\n", "short", "low", "bound", F.expr("left(word, low)"), F.expr("right(word, high)"))
    return rows.withColumn("key", key)


def _cut(rows: DataFrame) -> DataFrame:
    """Each partition's words twice: sharing the first half of what is left and parting later, and sharing the second
    half and parting before. ``low`` and ``high`` letters are shared at both ends, words part at ``low`` or later but before ``bound``."""
    half = "low + (short - low - high) DIV 2"
    later = F.struct(F.expr(f"CAST({half} AS INT)").alias("low"), F.col("high"), F.col("bound"))
    earlier = F.struct(F.col("low"), F.expr(f"CAST(short - ({half}) AS INT)").alias("high"), F.expr(f"CAST(least(bound, {half}) AS INT)").alias("bound"))
    cut = rows.select("word", "n", "short", F.explode(F.array(later, earlier)).alias("p")).select("word", "n", "short", "p.*")
    return _keyed(cut.where("low < bound"))


def _partitions(vocabulary: DataFrame, most: int) -> DataFrame:
    """word, n, short, low, bound, key: each word in the partitions that it may have a partner in.

    ``short`` is the length of the shorter word of a pair, so each word is there for its own length and for one less.
    """
    size = F.length("word")
    rows = vocabulary.select("word", "n", F.explode(F.array(size, size - 1)).alias("short")).where(F.col("short") >= 1)
    rows = rows.select("*", F.lit(0).alias("low"), F.lit(0).alias("high"), F.lit(_FAR).alias("bound"))
    rows, done = written(_cut(rows), "spelling-partitions"), []
    while True:
        large = rows.where("short - low - high > 1").groupBy("key").count().where(F.col("count") > most).select("key")
        large = written(large, "spelling-large")
        if large.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(large, "key", "left_anti").select(rows.columns))
        rows = written(_cut(rows.join(large, "key", "left_semi")), "spelling-partitions")
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    return found.select("key", "word", "n", "short", "low", "bound")


def _accepted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of each partition, whose rows follow each other."""

    def pairs(key: str, members: list[str], times: list[int]) -> None:
        short, low, bound = map(int, key.split("\n", 3)[:3])
        lengths = [len(w) for w in members]
        if len(members) < 2 or min(lengths) > short:
            return
        for a, b in Acceptor(members, low).near(bound - low):
            if lengths[a] == short or lengths[b] == short:
                out.append((members[a], times[a], members[b], times[b]))

    out: list[tuple] = []
    key, members, times = None, [], []
    for batch in batches:
        for k, word, n in zip(batch["key"], batch["word"], batch["n"]):
            if k != key:
                if members:
                    pairs(key, members, times)
                key, members, times = k, [], []
                if len(out) > 5_000:
                    yield pd.DataFrame(out, columns=["a", "a_n", "b", "b_n"])
                    out.clear()
            members.append(word)
            times.append(n)
    if members:
        pairs(key, members, times)
    if out:
        yield pd.DataFrame(out, columns=["a", "a_n", "b", "b_n"])


def near_words(vocabulary: DataFrame, most: int = MOST) -> DataFrame:
    """a, a_n, b, b_n: each pair of words of the vocabulary (word, n) that is one edit apart, once."""
    rows = _partitions(vocabulary, most).select("key", "word", "n")
    rows = rows.repartition("key").sortWithinPartitions("key", "word")
    return rows.mapInPandas(_accepted, "a string, a_n bigint, b string, b_n bigint")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: where the forms (word, form) lead to. Ways double each round; occurrences double with each form."""
    ways = written(forms.select("word", F.col("form").alias("root")), "spelling-ways")
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = written(ways.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-ways")
        ways = new.select("word", "root")
        if new.where("moved").isEmpty():
            return ways


def spelling_variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", most: int = MOST) -> DataFrame:
    """One row per word: word, n, n_near (words one edit apart), form (its commonest near word, if common enough), form_n, root.

    NULL and empty texts have no words; a NULL id counts as the empty text where letters are dropped. Repeated rows count
    as often as they are there. Words of any length are whole. Among near words of equal occurrences the first in code
    point order is the form. A table without words gives no rows. Only the id and the text are read.
    """
    vocabulary = written(words(docs, id_column, text_column), "spelling-words")
    pairs = written(near_words(vocabulary, most), "spelling-pairs")

    def way(a: str, b: str) -> Column:
        return F.struct(F.col(a).alias("word"), F.col(f"{a}_n").alias("n"), F.col(b).alias("near"), F.col(f"{b}_n").alias("near_n"))

    both = pairs.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("p")).select("p.*")
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("near_n"), "near")).alias("best"))
    best = best.select("word", "n", "n_near", F.col("best.near").alias("near"), (-F.col("best.col1")).alias("near_n"))
    common = F.col("near_n") >= RATIO * F.col("n")
    best = best.select("word", "n_near", F.when(common, F.col("near")).alias("form"), F.when(common, F.col("near_n")).alias("form_n"))
    best = written(best, "spelling-forms")
    roots = _roots(best.where("form IS NOT NULL"))
    return vocabulary.join(best, "word", "left").join(roots, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root")
    )
