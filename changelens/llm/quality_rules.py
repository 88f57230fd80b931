"""Quality rules, line first: lines that break a rule are removed, then documents that lost too much are rejected.

DataFrame functions only. Everything is computed inside the row, so nothing is shuffled; an array that several
expressions read is bound once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, text_of

#: A document is rejected if it loses more than this share of its characters (percent).
MOST_LOST = 50
#: Rules for a line of ``w`` words, any of which removes it.
SYMBOLS_PER_10_WORDS = 3
SHOUTED_WORDS = 5
UNENDED_WORDS = 8
PHRASE_WORDS = 20
REPEATED_WORDS = 10
DISTINCT_PER_10_WORDS = 4
SYMBOL = r"[#*$%&|<>{}\\]"
# Signs that end a sentence, and what navigation and boilerplate lines say (in lower case).
ENDS = list(".!?…。！？:;,\"”’)]")
PHRASES = [
    "accept cookies", "use cookies", "uses cookies", "cookie policy", "cookie settings", "enable javascript", "javascript is disabled", "privacy policy", "terms of use", "terms of service", "sign in", "sign up", "log in", "subscribe",
    "newsletter", "click here", "read more", "share this", "all rights reserved", "lorem ipsum", "skip to content", "back to top",
]
#: A phrase counts where no letter or digit stands beside it.
SAYS = rf"(?:^|[^\p{{L}}\p{{N}}])(?:{'|'.join(PHRASES)})(?:$|[^\p{{L}}\p{{N}}])"
BLANK_SIGNS = " \t\n\x0b\x0c\r"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once per row, however often it is read."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def _neighbours(ordered: Column, key: str) -> Column:
    """The items of an ordered array whose key the item before or after has too."""
    return F.filter(
        ordered, lambda x, at: (x[key] == F.get(ordered, at - 1)[key]) | (x[key] == F.get(ordered, at + 1)[key])
    )


def _covered(starts: Column) -> Column:
    """How many words the windows of three words at these places (in order) cover."""
    each = F.transform(starts, lambda s, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - s, F.lit(3))))
    return F.aggregate(each, F.lit(0), lambda total, size: total + size)


def _repeated(words: Column) -> Column:
    """How many words lie in a window of three words that is found twice or more."""

    def cut(windows: Column) -> Column:
        return F.slice(windows, 1, F.greatest(F.size(words) - 2, F.lit(0)))

    def hashed(word: Column, at: Column) -> Column:
        return F.xxhash64(word, F.get(words, at + 1), F.get(words, at + 2))

    def window(x: Column) -> Column:
        text = F.concat_ws(" ", *[F.get(words, x["at"] + i) for i in range(3)])
        return F.struct(text.alias("w"), x["at"].alias("at"))

    def with_places(hashes: Column) -> Column:
        return F.sort_array(F.transform(hashes, lambda h, at: F.struct(h.alias("h"), at.alias("at"))))

    def of(hashes: Column) -> Column:
        # Windows whose hashes all differ differ; those whose hashes agree are compared themselves.
        alike = bind(with_places(hashes), lambda x: _neighbours(x, "h"))
        equal = bind(F.sort_array(F.transform(alike, window)), lambda x: _neighbours(x, "w"))
        found = bind(F.sort_array(F.transform(equal, lambda x: x["at"])), _covered)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(found)

    return F.when(F.size(words) < 3, 0).otherwise(bind(cut(F.transform(words, hashed)), of))


def _may_say(text: Column) -> Column:
    """Whether the text has any of the phrases, be it inside of words: only then its lines are looked at."""
    return bind(F.lower(text), lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in PHRASES]))


def _fails(line: Column, phrases: Column) -> Column:
    """Whether a trimmed line with a word breaks a rule; ``phrases``: whether the document has any of the phrases."""

    def of(words: Column) -> Column:
        n = F.size(words)
        symbols = F.regexp_count(line, F.lit(SYMBOL)) * 10 > n * SYMBOLS_PER_10_WORDS
        capitals = F.char_length(F.regexp_replace(line, r"[^\p{Lu}]+", ""))
        signs = F.char_length(F.array_join(words, ""))
        shouted = (n >= SHOUTED_WORDS) & (capitals * 2 > signs)
        unended = (n >= UNENDED_WORDS) & ~F.substring(line, -1, 1).isin(ENDS)
        phrase = phrases & (n <= PHRASE_WORDS) & F.lower(line).rlike(SAYS)
        repeated = (n >= REPEATED_WORDS) & (F.size(F.array_distinct(words)) * 10 < n * DISTINCT_PER_10_WORDS)
        return symbols | unended | phrase | shouted | repeated

    return bind(words_of(line), of)


def _measures(text: Column) -> Column:
    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
            _repeated(words).cast("bigint").alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        def size(total: Column, line: Column) -> Column:
            return total + F.char_length(line)

        def clean(phrases: Column) -> Column:
            return F.filter(lines, lambda line: ~bind(F.btrim(line, F.lit(BLANK_SIGNS)), lambda x: _fails(x, phrases)))

        return F.struct(
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
            F.aggregate(lines, F.lit(0), size).cast("bigint").alias("line_chars"),
            bind(_may_say(text), clean).alias("clean"),
        )

    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return F.struct(bind(words_of(text), of_words).alias("w"), bind(lines, of_lines).alias("l"))


def quality_rules(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, the measures, base_failed, kept, lost_chars, cleaned (text).

    ``cleaned`` is the text without the lines that break a rule and without blank lines. NULL and empty texts have no
    words and fail. Texts of any length are measured whole. Only the id and the text are read, so other columns may
    have any name; ids may be NULL or repeat; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), bind(text_of(text_column), _measures).alias("m"))
    rows = rows.select(
        "doc_id",
        "m.w.*",
        "m.l.n_dup_lines",
        "m.l.line_chars",
        F.array_join("m.l.clean", "\n").alias("cleaned"),
        F.expr("CAST(aggregate(m.l.clean, 0, (total, line) -> total + char_length(line)) AS BIGINT)").alias("clean_chars"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    lost = F.col("line_chars") - F.col("clean_chars")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (100 * lost <= MOST_LOST * F.col("line_chars"))).alias("kept"),
        lost.alias("lost_chars"),
        "cleaned",
    )


_LINE = r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
_SAYS = f"regexp_matches(lower(l), '{SAYS}')"

SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
win AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
hit AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
rep AS (SELECT doc_id, sum(least(3, coalesce(nxt - i, 3))) AS n
        FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM hit) GROUP BY doc_id),
line AS (SELECT doc_id, line, {_LINE} AS l
         FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
         WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
lw AS (SELECT *, list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM line),
rule AS (SELECT *, len(regexp_extract_all(l, '[#*$%&|<>{{}}\\]')) * 10 > len(words) * {SYMBOLS_PER_10_WORDS}
              OR (len(words) >= {SHOUTED_WORDS}
                  AND len(regexp_extract_all(l, '\p{{Lu}}')) * 2 > length(list_aggregate(words, 'string_agg', '')))
              OR (len(words) >= {UNENDED_WORDS} AND NOT contains('.!?…。！？:;,"”’)]', right(l, 1)))
              OR (len(words) <= {PHRASE_WORDS} AND ({_SAYS}))
              OR (len(words) >= {REPEATED_WORDS} AND len(list_distinct(words)) * 10 < len(words) * {DISTINCT_PER_10_WORDS}) AS fails
         FROM lw),
per AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, sum(length(line)) AS chars,
               coalesce(sum(length(line)) FILTER (WHERE fails), 0) AS lost FROM rule GROUP BY doc_id),
m AS (SELECT doc_id, len(words) AS n_words, length(list_aggregate(words, 'string_agg', '')) AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(n, 0) AS n_repeat_words, coalesce(chars, 0) AS chars, coalesce(lost, 0) AS lost
      FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN per USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost <= {MOST_LOST} * chars AS kept,
       lost::BIGINT AS lost_chars
FROM m
"""
