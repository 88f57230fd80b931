"""Regular-expression extraction with the flag and group rules of the rule format."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .artifacts import artifact, bind, or_empty

_WIDE_SPACE = "\\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def js_flags(flags: str = "") -> str:
    """Inline Java modifiers. Matching is always global; multi-line unless the user wrote ``g`` without ``m``."""
    unknown = set(flags) - set("dgimsuvy")
    if unknown or len(set(flags)) != len(flags):
        raise ValueError(f"Invalid flags supplied to regular expression: {flags!r}")
    mods = ""
    if "g" not in flags or "m" in flags:
        mods += "m"
    if "i" in flags:
        mods += "iu"
    if "s" in flags:
        mods += "s"
    return f"(?{mods})" if mods else ""


_ESCAPE = r"\\(?:u\{[0-9A-Fa-f]+\}|u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}|c[A-Za-z]|[pP]\{[^}]*\}|k<[^>]*>|\d+|.)"
_QUANTIFIER = r"\{\d+(?:,\d*)?\}"


def _escape(token: str, in_class: bool, names: dict[str, int]) -> str:
    if token == "\\s":
        return _WIDE_SPACE if in_class else f"[{_WIDE_SPACE}]"
    if token == "\\S" and not in_class:
        return f"[^{_WIDE_SPACE}]"
    if token.startswith("\\k<"):
        return f"\\{names[token[3:-1]]}"
    if token.startswith("\\u{"):
        return "\\x" + token[2:]
    if token == "\\0":
        return "\\x00"
    if token == "\\b" and in_class:
        return "\\x08"
    return token


# In Java a line also starts after other signs but not behind the last newline, and ``$`` looks past a last newline.
_LINE_ENDS = "\\n\\r\u2028\u2029"
_EDGES = {
    ("^", True): f"(?<![^{_LINE_ENDS}])",
    ("$", True): f"(?![^{_LINE_ENDS}])",
    ("^", False): r"\A",
    ("$", False): r"\z",
}


def _plain_run(tokens: list[str]) -> str:
    """The plain characters that tokens begin with, without one that may be repeated or left out."""
    run = ""
    for i, token in enumerate(tokens):
        if len(token) > 1 or token in "()[]{}^$.|*+?\\" or token > "\ud7ff":
            return run[:-1] if token[0] in "*+?{" else run
        run += token
    return run


def java_pattern(pattern: str, flags: str = "") -> tuple[str, dict[str, int]]:
    """The same pattern for Java with numbered groups, and the number of each named group.

    Java group names allow no underscores, so names become numbers. ``\\s`` is widened to the Unicode
    blanks, ``[^]`` means any character, ``[`` inside a class and a brace that repeats nothing are plain.
    Whether a line starts is asked behind the plain text that follows, as Java looks for that much faster.
    """
    names: dict[str, int] = {}
    groups, in_class = 0, False
    many = "g" not in flags or "m" in flags
    out = []
    tokens = re.findall(rf"{_ESCAPE}|\[\^\]|\[\^?|\(\?<(?![=!])[^>]*>|\(\?|{_QUANTIFIER}|.", pattern, re.S)
    for at, token in enumerate(tokens):
        if token[0] == "\\":
            out.append(_escape(token, in_class, names))
        elif in_class:
            in_class = token != "]"
            out.append("".join("\\" + c if c in "[&" else c for c in token))
        elif token == "[^]":
            out.append(r"[\s\S]")
        elif token in ("[", "[^"):
            in_class = True
            out.append(token)
        elif token.startswith("(?<") and token.endswith(">"):
            groups += 1
            names[token[3:-1]] = groups
            out.append("(")
        elif token in "^$":
            out.append(_EDGES[token, many])
            run = _plain_run(tokens[at + 1 :]) if token == "^" and many else ""
            if run:
                out[-1] = f"{run}(?<={out[-1]}{run})"
                del tokens[at + 1 : at + 1 + len(run)]
        else:
            groups += token == "("
            out.append("\\{" if token == "{" else token)
    body = "".join(out)
    if "y" in flags:
        body = rf"\G(?:{body})"
    return js_flags(flags) + body, names


def group_maps(content: Column, rx: str, names: dict[str, int]) -> Column:
    """One map per match from group name to text; groups that took no part are left out."""
    every = F.regexp_extract_all(content, F.lit(rx), F.lit(0))
    if not names:
        return F.transform(every, lambda _: F.create_map().cast("map<string,string>"))
    flags, body = re.match(r"((?:\(\?[a-z]+\))?)(.*)", rx, re.S).groups()
    groups = _groups(body)

    def took_part(i: int) -> str:
        return rf"{flags}(?:{body})(?:(?=\{i})(?<=([\s\S])))?"

    columns = [F.regexp_extract_all(content, F.lit(rx), F.lit(i)).alias(f"g{i}") for i in names.values()]
    # An empty group may have matched the empty text or taken no part. A reference to it holds in the first case only,
    # and one more group then takes the character before the end, so that there is something to see.
    unsure = [i for i in names.values() if _may_be_empty(groups[i - 1])]
    columns += [F.regexp_extract_all(content, F.lit(took_part(i)), F.lit(len(groups) + 1)).alias(f"p{i}") for i in unsure]

    def one(m: Column) -> Column:
        def entry(n: str, i: int) -> Column:
            there = (m[f"g{i}"] != "") | (m[f"p{i}"] != "") if i in unsure else m[f"g{i}"] != ""
            return F.when(there, F.struct(F.lit(n).alias("key"), m[f"g{i}"].alias("value")))

        return F.map_from_entries(F.array_compact(F.array(*[entry(n, i) for n, i in names.items()])))

    return F.transform(F.arrays_zip(*columns), one)


def _groups(body: str) -> list[str]:
    """What the capturing groups of a translated pattern hold, by number."""
    found, waiting, at = [], [], 0
    for token in re.findall(r"\\.|\[(?:\\.|[^\]\\])*\]|\(\?|.", body, re.S):
        at += len(token)
        if token == "(":
            waiting.append(len(found))
            found.append(at)
        elif token == "(?":
            waiting.append(None)
        elif token == ")" and waiting:
            number = waiting.pop()
            if number is not None:
                found[number] = body[found[number] : at - 1]
    return found


def _may_be_empty(group: str) -> bool:
    """Whether a group may match the empty text; a doubt counts as yes."""
    if re.search(r"\(\?[=!<]|\\[bBzGA1-9]", group):
        return True
    try:
        return re.fullmatch(group, "") is not None
    except re.error:
        return True


def required_literal(pattern: str, flags: str = "") -> str:
    """The longest plain text every match must hold; '' when none is certain. Only top-level text counts."""
    if "i" in flags:
        return ""
    # Groups, classes and escapes end a run of plain characters; so does a character that may be left out.
    token = rf"{_ESCAPE}|\[(?:\\.|[^\]\\])*\]|[*+?]\??|{_QUANTIFIER}\??|."
    depth, run, runs = 0, "", [""]
    for t in re.findall(token, pattern, re.S):
        if t == "|" and depth == 0:
            return ""
        plain = depth == 0 and len(t) == 1 and t not in "()[]{}^$.|*+?\\"
        if t[0] in "*?{" and run:
            run = run[:-1]
        depth += {"(": 1, ")": -1}.get(t, 0)
        if plain:
            run += t
        else:
            runs.append(run)
            run = ""
    return max([*runs, run], key=len)


def all_matches(content: Column, pattern: str, flags: str = "") -> Column:
    """Whole matches in order. A text without the pattern's certain characters is not searched."""
    rx, _ = java_pattern(pattern, flags)
    found = F.regexp_extract_all(content, F.lit(rx), F.lit(0))
    literal = required_literal(pattern, flags)
    if not literal:
        return found
    return F.when(F.contains(content, F.lit(literal)), found).otherwise(F.array().cast("array<string>"))


def regex_extract(content: Column, pattern: str, flags: str = "") -> Column:
    """All matches joined by newlines, with the named groups of each match as context."""
    rx, names = java_pattern(pattern, flags)
    groups = F.to_json(group_maps(content, rx, names)) if names else F.lit("[]")
    found = bind(
        all_matches(content, pattern, flags),
        lambda m: artifact(F.array_join(m, "\n"), F.when(F.size(m) > 0, F.array(groups))),
    )
    return or_empty(found, content)
