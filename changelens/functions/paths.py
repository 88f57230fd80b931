"""Paths: globs, effective paths, extensions and languages."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extension -> language.
LANGUAGES = {
    ".c": "c",
    ".cpp": "cpp",
    ".cxx": "cpp",
    ".go": "go",
    ".h": "c",
    ".hpp": "cpp",
    ".java": "java",
    ".js": "javascript",
    ".json": "json",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".py": "python",
    ".rs": "rust",
    ".ts": "typescript",
    ".tsx": "typescript",
}


def _range(text: str) -> list[str]:
    """``1..3``, ``01..12``, ``a..e``, each also with a step; nothing for other texts."""
    span = re.fullmatch(r"(-?\d+|[A-Za-z])\.\.(-?\d+|[A-Za-z])(?:\.\.(-?\d+))?", text)
    if not span or span[1].isalpha() != span[2].isalpha():
        return []
    low, high = (ord(x) if x.isalpha() else int(x) for x in span.group(1, 2))
    step = abs(int(span[3] or 1)) or 1
    numbers = range(low, high + 1, step) if low <= high else range(low, high - 1, -step)
    if span[1].isalpha():
        return [chr(n) for n in numbers]
    padded = any(re.match(r"-?0\d", x) for x in span.group(1, 2))
    width = max(map(len, span.group(1, 2))) if padded else 0
    return [f"{n:0{width}d}" for n in numbers]


# The named classes of characters, as Java writes them.
CLASSES = {
    "alpha": "\\p{L}", "digit": "\\p{Nd}", "alnum": "\\p{L}\\p{Nd}", "upper": "\\p{Lu}", "lower": "\\p{Ll}", "space": "\\s", "blank": " \\t",
    "punct": "\\p{Punct}", "xdigit": "0-9A-Fa-f", "word": "\\w", "cntrl": "\\p{Cntrl}", "print": "\\p{Print}", "graph": "\\p{Graph}",
}


def _class(body: str) -> str:
    """The inside of a bracket expression; named classes may stand among the characters."""
    out = ""
    for part in re.findall(r"\[:\w+:\]|[\s\S]", body):
        if len(part) > 1:
            if part[2:-2] not in CLASSES:
                raise ValueError(f"Unknown character class {part!r}")
            out += CLASSES[part[2:-2]]
        else:
            out += re.sub(r"[\\\[&]", r"\\\g<0>", part)
    return out


def _braces(glob: str) -> list[str]:
    """``a.{b,c}`` -> ``a.b``, ``a.c``; also ranges; nested groups allowed."""
    depth, start = 0, -1
    for i, ch in enumerate(glob):
        if ch == "{" and (i == 0 or glob[i - 1] != "\\"):
            if depth == 0:
                start, commas = i, []
            depth += 1
        elif ch == "," and depth == 1:
            commas.append(i)
        elif ch == "}" and depth:
            depth -= 1
            if depth:
                continue
            options = _range(glob[start + 1 : i])
            if options:
                pass
            elif commas:
                cuts = [start, *commas, i]
                options = [glob[a + 1 : b] for a, b in zip(cuts, cuts[1:])]
            else:
                continue
            return [done for o in options for done in _braces(glob[:start] + o + glob[i + 1 :])]
    return [glob]


def _segment(seg: str) -> str:
    """One path segment as a regular expression; wildcards never match a leading dot."""
    out, i = "", 0
    while i < len(seg):
        ch = seg[i]
        i += 1
        if ch == "*":
            while seg[i : i + 1] == "*":
                i += 1
            out += "[^/]+" if len(seg.strip("*")) == 0 else "[^/]*"
        elif ch == "?":
            out += "[^/]"
        elif ch == "[" and "]" in seg[i + 1 :]:
            found = re.compile(r"([!^]?)((?:\]|\[:\w+:\]|[^\]])(?:\[:\w+:\]|[^\]])*)\]").match(seg, i)
            if found is None:
                out += re.escape(ch)
                continue
            out += f"[{'^/' if found[1] else ''}{_class(found[2])}]"
            i = found.end()
        elif ch == "\\" and i < len(seg):
            out += re.escape(seg[i])
            i += 1
        else:
            out += re.escape(ch)
    return ("(?!\\.)" if seg[:1] in ("*", "?", "[") else "") + out


def glob_variants(glob: str) -> list[str]:
    """The globs without braces that a glob stands for; a negated one stays whole."""
    return [glob] if glob[:1] in ("!", "#") else _braces(glob)


def glob_regex(glob: str) -> tuple[str, bool]:
    """An anchored Java regular expression for a glob, and whether the glob is negated."""
    negated = False
    while glob.startswith("!"):
        negated, glob = not negated, glob[1:]
    if glob.startswith("#"):
        return r"\A(?!)", negated
    if re.search(r"[!+@*?]\(", glob):
        raise ValueError(f"Extended globs are not supported: {glob!r}")
    some = r"(?!\.)[^/]+"
    variants = []
    for variant in _braces(glob):
        segs = variant.split("/")
        rx = ""
        for i, seg in enumerate(segs):
            last = i == len(segs) - 1
            if seg == "**":
                rx += f"{some}(?:/{some})*" if last else f"(?:{some}/)*"
            else:
                rx += _segment(seg) + ("" if last else "/")
        variants.append(rx)
    return r"\A(?:" + "|".join(variants) + r")\z", negated


def glob_any(path: Column, include: Iterable[str]) -> Column:
    """True when the path matches any of the globs. Patterns are literals, so each compiles once per task."""
    tests = []
    for glob in include:
        rx, negated = glob_regex(glob)
        tests.append(~path.rlike(rx) if negated else path.rlike(rx))
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def effective_path(new: Column, old: Column) -> Column:
    """The new path, or the old one when the file is gone."""
    return F.coalesce(F.when((new != "") & (new != "/dev/null"), new), old)


def file_ext(path: Column) -> Column:
    """Extension with its dot, lower-cased; '' when there is none or the name only starts with a dot."""
    ext = F.regexp_extract(path, r"[^/](\.[^./]*)/*$", 1)
    return F.lower(F.when(path.rlike(r"(^|/)\.\./*$"), "").otherwise(ext))


def language_of(path: Column, override: str | None = None, strict: bool = True) -> Column:
    """Language by extension; ``override`` is an extension that wins. Unknown: error, or NULL when not strict."""
    if override is not None:
        if override.lower() not in LANGUAGES:
            raise ValueError(f"Unsupported language for extension: {override}")
        return F.lit(LANGUAGES[override.lower()])
    ext = file_ext(path)
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    found = F.try_element_at(table, ext)
    if not strict:
        return found
    return F.coalesce(found, F.raise_error(F.concat(F.lit("Unsupported language for extension: "), ext)).cast("string"))
