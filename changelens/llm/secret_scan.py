"""Secret scan: strings in a sensitive context that a primed compressor cannot predict.

Three fixed patterns give the base findings. Beyond them, each string that stands right after a sensitive word is a
candidate. Its novelty is measured with zstandard, primed with a dictionary of common identifiers and with the text
around the candidate: the bytes by which the compressed size grows when the candidate is added, per character.
Words, names and placeholders are cheap to predict; random keys are not and are reported.
"""

from __future__ import annotations

import functools
import random
import re

import ahocorasick
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, and the least length of a finding.
ASSIGN = re.compile(
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ASSIGN_VALUE = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")

# Words that make what follows sensitive.
SENSITIVE = (
    "password passwd passphrase pwd secret token api_key apikey api-key access_key access-key accesskey secretaccesskey private_key "
    "private-key privatekey secret_key secret-key secretkey encryption_key encryption-key encryptionkey "
    "credential authorization auth client_id client-id signature session_id session-id cookie login pin key salt hash"
).split()
SCHEMES = ("bearer", "basic")
VALUE = re.compile(r"""[^\s"'()<>{},;]+""")
AFTER_WORD = re.compile(r"""s?["']?[\x20\t]*(?:[:=]+>?|is\b|\()[\x20\t]*["'(]*""")
AFTER_SCHEME = re.compile(r"[\x20\t]+")
#: Characters before and after a candidate that the compressor has seen.
AROUND = 256
#: Growth in bytes per byte from which a candidate is new: random letters and digits need 0.79 and more, names and
#: words up to 0.75. Shorter strings differ by chance, and one without digits or inner capitals is a word.
NOVEL = 0.78
LEAST = 16
_MIXED = re.compile(r"[0-9]|[a-z][A-Z]")
#: Strings from SHORT characters on are measured if they have small and capital letters, digits and signs. Others need
#: LEAST: of 400 random strings of 8 letters and digits half have a novelty of 1.0 or less (least 0.75), and of 400
#: names with a digit half have 0.75 or more and at least one in twenty 1.0 or more, so novelty does not part them.
SHORT = 8
_KINDS = [re.compile(kind) for kind in ("[a-z]", "[A-Z]", "[0-9]", r"[!#$%&*+?@^~|=]")]
#: Values of more than LONG characters are measured in pieces of PIECE: over a long run of letters and digits the
#: table of their bits costs nothing any more, and the growth falls to 0.75 bytes however random they are.
LONG = 512
PIECE = 256
LEVEL = 3
DICTIONARY_BYTES = 4_096

IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key credential authorization bearer session cookie "
    "username user_name email address config configuration settings environment variable default example placeholder "
    "changeme your_password_here your_token_here insert_key_here xxxxxxxxxxxxxxxx undefined null none true false string "
    "function return import export require const let var public private static final class struct interface void int "
    "getPassword setPassword getToken setToken getSecret getApiKey process.env os.environ System.getenv config.get "
    "http https www example com org net localhost 127.0.0.1 application json content type text html charset utf-8 "
    "database connection host port server client request response status message error exception handler callback "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 0000000000000000 "
    "the of and to in that is was for with as on this are be by it from at or an have not but which you all can will "
    "first second last index number count length value key name path file directory version release master main test"
)

_NAMES = ["n_assign", "n_access", "n_hex", "base_spans", "spans", "novel"]
SCHEMA = (
    "n_assign bigint, n_access bigint, n_hex bigint, base_spans string, spans string,"
    " novel array<struct<start:int,end:int,novelty:double>>"
)


@functools.lru_cache(maxsize=1)
def _primed() -> zstandard.ZstdCompressor:
    """A compressor that knows the identifiers, and how often their letters are, from lines made of them."""
    rng, words = random.Random(5), IDENTIFIERS.split()
    joins = ("_".join, "-".join, ".".join, " ".join, lambda some: "".join(w[:1].upper() + w[1:] for w in some))

    def name() -> str:
        return rng.choice(joins)([rng.choice(words) for _ in range(rng.randint(1, 4))])

    lines = [f'{name()} = "{name()}"; {name()}({name()}, {rng.randint(0, 999)}): {name()}\n'.encode() for _ in range(4_000)]
    known = zstandard.train_dictionary(DICTIONARY_BYTES, lines)
    known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_dict_id=False)


def novelty(before: str, candidate: str, after: str) -> float:
    """Compressed bytes that the candidate adds to its surroundings (without copies of itself), per byte of it."""
    around, own = f"{before}\n{after}\n".replace(candidate, "").encode(), candidate.encode()
    compress = _primed().compress
    # Put last, the candidate can draw on everything around it.
    return (len(compress(around + own)) - len(compress(around))) / max(1, len(own))


def value_novelty(text: str, start: int, end: int) -> float:
    """The novelty of the value at a place of the text; for a long one, the mean over its pieces."""
    cuts = [start, end] if end - start <= LONG else [*range(start, end - PIECE + 1, PIECE), end]
    parts = [(text[a:b], text[max(0, a - AROUND) : a], text[b : b + AROUND]) for a, b in zip(cuts, cuts[1:])]
    return sum(novelty(before, part, after) * len(part) for part, before, after in parts) / max(1, end - start)


@functools.lru_cache(maxsize=1)
def _sensitive() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for words, after in ((SENSITIVE, AFTER_WORD), (SCHEMES, AFTER_SCHEME)):
        for word in words:
            found.add_word(word, (word, after))
    found.make_automaton()
    return found


def base_findings(text: str, assigned: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base findings, in code points; ``assigned``: look for assignments at all."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_VALUE] if assigned else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def sensitive_words(text: str) -> list[tuple[int, str, re.Pattern]]:
    """End, word and what may follow, of each sensitive word, in any case and also inside other words."""
    lowered = text.encode().lower().decode()  # ASCII only, so places stay
    return [(end + 1, word, after) for end, (word, after) in _sensitive().iter(lowered)]


def _at_border(text: str, start: int) -> bool:
    """Whether no letter stands before the word at ``start``, or the word begins with an inner capital."""
    if start == 0 or not text[start - 1].isalpha():
        return True
    return text[start].isupper() and (text[start - 1].islower() or text[start + 1].islower())


def _measurable(value: str) -> bool:
    if len(value) >= LEAST:
        return bool(_MIXED.search(value))
    return len(value) >= SHORT and all(kind.search(value) for kind in _KINDS)


def novel_findings(text: str, words: list, known: list[tuple[int, int, int]]) -> list[tuple[int, int, float]]:
    """(start, end, novelty) of candidates that are new and do not overlap a base finding (sorted by start)."""
    found, reach, at, done = [], 0, 0, 0
    for place, word, after in words:
        head = after.match(text, place) if _at_border(text, place - len(word)) else None
        # A value is read once, however many words stand in it: what is left of it behind them is no other value.
        value = VALUE.match(text, head.end()) if head and head.end() >= done else None
        if value is None:
            continue
        start, end = value.start(), value.start() + len(value[0].rstrip(".:!?"))
        done = end
        if not _measurable(text[start:end]):
            continue
        while at < len(known) and known[at][0] < end:
            reach, at = max(reach, known[at][2]), at + 1
        if reach > start:
            continue
        new = value_novelty(text, start, end)
        if new >= NOVEL:
            found.append((start, end, round(new, 4)))
    return found


def scan(text: str | None) -> tuple:
    """The columns of ``SCHEMA`` for one text; NULL counts as empty."""
    text = text or ""
    words = sensitive_words(text)
    base = base_findings(text, assigned=bool(words))
    novel = novel_findings(text, words, base)
    counts = [sum(kind == k for _, kind, _ in base) for k in range(3)]
    spans = sorted(base + [(start, len(KINDS), end) for start, end, _ in novel])
    written = [",".join(f"{(*KINDS, 'novel')[kind]}:{start}:{end}" for start, kind, end in s) for s in (base, spans)]
    return *counts, *written, [{"start": s, "end": e, "novelty": n} for s, e, n in novel]


def scanned(text: Column) -> Column:
    """A struct with the columns of ``SCHEMA``."""

    @F.pandas_udf(SCHEMA)
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([scan(t) for t in texts], columns=_NAMES)

    return of(text)


def secret_scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id and the columns of ``SCHEMA``; spans are kind:start:end, the end exclusive.

    Base findings of one kind do not overlap, those of different kinds may. NULL and empty texts have none. Only the
    id and the text are read, so other columns may have any name; ids may be NULL or repeat; an empty table gives no
    rows. A text of any length is read whole.
    """
    return docs.select(id_column, scanned(F.col(text_column)).alias("found")).select(id_column, "found.*")
