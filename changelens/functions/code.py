"""Source code: declarations by language, and code-like templates with holes.

Brackets nest to any depth, which no plain pattern can follow, so both are read by small Arrow-batched functions:
one pass blanks out comments and strings, one pairs the brackets, and headers are then looked up in what is left.
Rows that cannot have a match hand them no text.
"""

from __future__ import annotations

import functools
import re
from functools import reduce

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .artifacts import artifact, bind, or_empty
from .paths import language_of

_ID = r"([A-Za-z_$][\w$]*)"
_SCRIPT = r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?"
_JAVA = r"(?:(?:public|protected|private|static|final|abstract|sealed|strictfp)\s+)*+"
_RUST = r"(?:pub(?:\([^)]*\))?\s+)?"
_METHOD = r"(?!(?:if|for|while|switch|catch|return|else|new|throw)\b)"
_TYPED = r"(?!(?:typedef|class|enum|return|namespace|if|else|for|while|switch|case|new|delete|using|throw|goto)\b)"

# How the header of a declaration starts, by language and kind; the name is the only group.
HEADERS = {
    "javascript": {
        "function": rf"{_SCRIPT}(?:async\s+)?function\s*\*?\s*{_ID}",
        "class": rf"{_SCRIPT}class\s+{_ID}",
        "method": rf"[ \t]++(?:static\s+)?(?:async\s+)?(?:get\s+|set\s+)?\*?{_METHOD}{_ID}\s*\(",
    },
    "typescript": {
        "function": rf"{_SCRIPT}(?:async\s+)?function\s*\*?\s*{_ID}",
        "class": rf"{_SCRIPT}(?:abstract\s+)?class\s+{_ID}",
        "interface": rf"{_SCRIPT}interface\s+{_ID}",
        "type": rf"{_SCRIPT}type\s+{_ID}",
        "enum": rf"{_SCRIPT}(?:const\s+)?enum\s+{_ID}",
        "method": rf"[ \t]++(?:(?:public|protected|private|static|override|readonly|abstract)\s+)*(?:async\s+)?(?:get\s+|set\s+)?\*?{_METHOD}{_ID}\s*(?:<[^>\n]*>)?\(",
    },
    "python": {
        "function": rf"(?:async\s+)?def\s+{_ID}",
        "class": rf"class\s+{_ID}",
        "method": rf"[ \t]++(?:async\s+)?def\s+{_ID}",
        "decorated": rf"(?:@[^\n]*\n)+(?:async\s+def|def|class)\s+{_ID}",
    },
    "go": {
        "function": rf"func\s+{_ID}",
        "method": rf"func\s+\([^)\n]*\)\s*{_ID}",
        "struct": rf"type\s+{_ID}(?:\[[^\]\n]*\])?\s+struct\b",
        "interface": rf"type\s+{_ID}(?:\[[^\]\n]*\])?\s+interface\b",
        "type": rf"type\s+{_ID}",
    },
    "java": {
        "class": rf"{_JAVA}class\s+{_ID}",
        "interface": rf"{_JAVA}interface\s+{_ID}",
        "enum": rf"{_JAVA}enum\s+{_ID}",
        "method": rf"[ \t]++{_JAVA}(?:synchronized\s+|default\s+)*(?:<[^>\n]*>\s+)?(?!(?:return|new|else|throw)\b)[\w.<>\[\],? ]*[\w>\]]\s+{_ID}\s*\(",
    },
    "rust": {
        "function": rf"{_RUST}(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+{_ID}",
        "struct": rf"{_RUST}struct\s+{_ID}",
        "enum": rf"{_RUST}enum\s+{_ID}",
        "trait": rf"{_RUST}trait\s+{_ID}",
        "type": rf"{_RUST}type\s+{_ID}",
        "impl": rf"(?:unsafe\s+)?impl(?:<[^>\n]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?{_ID}",
    },
    "c": {
        "function": rf"{_TYPED}[A-Za-z_][\w \t*]*[ \t*]{_ID}\s*\(",
        "struct": rf"(?:typedef\s+)?struct\s+{_ID}",
        "enum": rf"(?:typedef\s+)?enum\s+{_ID}",
    },
    "cpp": {
        "function": rf"{_TYPED}[A-Za-z_][\w:<>, \t*&]*[ \t*&:~]{_ID}\s*\(",
        "class": rf"(?:template\s*<[^>\n]*>\s*)?class\s+{_ID}",
        "struct": rf"(?:template\s*<[^>\n]*>\s*)?struct\s+{_ID}",
        "enum": rf"enum\s+(?:class\s+)?{_ID}",
    },
}


# What a comment, a string or a character looks like.
_LINE_COMMENT, _BLOCK_COMMENT = r"//[^\n]*", r"/\*[\s\S]*?(?:\*/|\Z)"
_STRING, _CHAR, _TICKS = r'"(?:\\.|[^"\\\n])*"?', r"'(?:\\[^\n']{1,8}|\\'|[^'\\\n])'", r"`(?:\\[\s\S]|[^`\\])*`?"
_QUOTED = r"'(?:\\.|[^'\\\n])*'?"
OPAQUE = {
    "javascript": [_LINE_COMMENT, _BLOCK_COMMENT, _STRING, _QUOTED, _TICKS],
    "typescript": [_LINE_COMMENT, _BLOCK_COMMENT, _STRING, _QUOTED, _TICKS],
    "python": [r'"""[\s\S]*?(?:"""|\Z)', r"\'\'\'[\s\S]*?(?:\'\'\'|\Z)", r"#[^\n]*", _STRING, _QUOTED],
    "go": [_LINE_COMMENT, _BLOCK_COMMENT, _STRING, _CHAR, r"`[^`]*`?"],
    "java": [r'"""[\s\S]*?(?:"""|\Z)', _LINE_COMMENT, _BLOCK_COMMENT, _STRING, _CHAR],
    "rust": [_LINE_COMMENT, _BLOCK_COMMENT, r'\br(#*)"[\s\S]*?"\1', r'"(?:\\[\s\S]|[^"\\])*"?', _CHAR],
    "c": [_LINE_COMMENT, _BLOCK_COMMENT, _STRING, _CHAR],
    "cpp": [_LINE_COMMENT, _BLOCK_COMMENT, _STRING, _CHAR],
}
_PAIRS = {")": "(", "]": "[", "}": "{"}
_TEXT = re.compile(r"\S")
_BRACKET, _STOP, _STOP_OR_LINE = re.compile(r"[()\[\]{}]"), re.compile(r"[()\[\]{};]"), re.compile(r"[()\[\]{};\n]")
#: Kinds whose declaration may end without a block.
BLOCKLESS = {("java", "method"), ("rust", "function"), ("rust", "struct"), ("c", "struct"), ("cpp", "struct")}


@functools.cache
def _opaque(language: str) -> re.Pattern:
    return re.compile("|".join(OPAQUE[language]))


def masked(content: str, language: str) -> str:
    """The content with comments as blanks and strings as quotes; every other character keeps its place."""

    def mask(m: re.Match) -> str:
        return re.sub(r"[^\n]", " ", m[0]) if m[0].startswith(("//", "/*", "#")) else '"' * len(m[0])

    return _opaque(language).sub(mask, content)


def pairs(code: str) -> dict[int, int]:
    """The place of the closing bracket of each opening one that is closed."""
    found, waiting = {}, []
    for match in _BRACKET.finditer(code):
        if match[0] in "([{":
            waiting.append(match.start())
        elif waiting and code[waiting[-1]] == _PAIRS[match[0]]:
            found[waiting.pop()] = match.start()
    return found


def _python_end(code: str, closed: dict[int, int], at: int, indent: int) -> int:
    """The end of the last line before one that is indented no deeper than the header."""
    while at < len(code):
        match = _STOP_OR_LINE.search(code, at)
        if match is None:
            return len(code)
        at = match.end()
        if match[0] in "([{":
            at = closed.get(match.start(), len(code)) + 1
        elif match[0] == "\n":
            next_text = _TEXT.search(code, at)
            if next_text is None:
                return match.start()
            start = code.rfind("\n", 0, next_text.start()) + 1
            if next_text.start() - start <= indent:
                return match.start()
    return len(code)


def _line_ends(code: str, at: int) -> bool:
    """Whether a type declaration ends at this line break: neither side of it carries the expression on."""
    before, after = code[:at].rstrip()[-1:], code[at:].lstrip()[:1]
    return before not in "=|&,<(?:" and after not in tuple("|&?:=.,")


def _block_end(code: str, closed: dict[int, int], at: int, language: str, kind: str) -> int | None:
    """The end of a declaration whose name ends at ``at``; None if it has no block but needs one."""
    stop = _STOP_OR_LINE if kind == "type" and language in ("typescript", "go") else _STOP
    callable_ = kind in ("function", "method")
    after = None  # the end of the parameters
    while True:
        match = stop.search(code, at)
        if match is None:
            return len(code) if kind == "type" else None
        place, sign = match.start(), match[0]
        if sign == "\n":
            if _line_ends(code, place):
                return place
        elif sign == ";":
            return place + 1 if kind == "type" or (language, kind) in BLOCKLESS else None
        elif sign in ")]}":
            return place if kind == "type" else None
        elif sign == "{" and kind != "type":
            between = code[after:place].strip() if callable_ and after is not None else ""
            is_type = (language == "typescript" and between[:1] == ":" and between[-1] in ":|&<,") or (
                language == "go" and re.search(r"\b(?:interface|struct)$", between)
            )
            if not is_type:
                if kind == "method" and (between and language == "javascript" or between[:1] not in ("", ":") and language == "typescript"):
                    return None
                return closed.get(place, len(code) - 1) + 1
        at = closed.get(place, len(code)) + 1 if sign in "([{" else place + 1
        if after is None and sign == "(":
            after = at


@functools.cache
def _header(language: str, kind: str) -> re.Pattern:
    header = HEADERS[language][kind]
    return re.compile(rf"^{header}" if kind == "method" else rf"^[ \t]*+{header}", re.MULTILINE)


def find_declarations(content: str, language: str, kind: str) -> list[dict[str, str]]:
    """Name and whole text of the declarations of a kind in order, nested ones too."""
    code, found = masked(content, language), []
    closed = pairs(code)
    for match in _header(language, kind).finditer(code):
        start = match.start() + len(match[0]) - len(match[0].lstrip())
        indent = start - code.rfind("\n", 0, start) - 1
        if language == "python":
            end = _python_end(code, closed, match.end(1), indent)
        else:
            end = _block_end(code, closed, match.end(1), language, kind)
        if end is not None:
            found.append({"name": match[1], "body": content[start:end]})
    return found


def declarations(path: Column, content: Column, kind: str, override: str | None = None, strict: bool = True) -> Column:
    """``struct(names, bodies)`` of the declarations of a kind, by the language of the path.

    Languages without that kind have none; content without a known language is an error when strict.
    """
    having = [name for name, kinds in HEADERS.items() if kind in kinds]
    if not having:
        raise ValueError(f"Unknown declaration kind: {kind}")

    @F.pandas_udf("array<struct<name:string,body:string>>")
    def found(contents: pd.Series, languages: pd.Series) -> pd.Series:
        return pd.Series([[] if text is None else find_declarations(text, lang, kind) for text, lang in zip(contents, languages)], dtype=object)

    # The function sees all rows, also those for which nobody asks; only who asks gets the error.
    each_language = language_of(path, override, False)
    each = found(F.when(each_language.isin(having), content), each_language)
    language = language_of(path, override, strict)
    names, bodies = F.transform(each, lambda d: d["name"]), F.transform(each, lambda d: d["body"])
    return F.when(language.isNotNull(), F.struct(names.alias("names"), bodies.alias("bodies")))


def code_extract(
    content: Column, path: Column, kind: str, capture: str = "body", language: str | None = None
) -> Column:
    """The artifact of a declaration rule: names or whole declarations; names are context of declarations."""
    if capture not in ("name", "body"):
        raise ValueError(f"Unknown capture: {capture}")

    def shown(found: Column) -> Column:
        if capture == "name":
            return artifact(F.array_join(found["names"], "\n\n"), F.array(F.lit("[]")))
        names = F.to_json(F.transform(found["names"], lambda n: F.create_map(F.lit("name"), n)))
        return artifact(F.array_join(found["bodies"], "\n\n"), F.array(names))

    return or_empty(bind(declarations(path, content, kind, language), shown), content)


_TEXTS = r"""\"(?:\\.|[^\"\\\n])*+\"|'(?:\\.|[^'\\\n])*+'|`(?:\\[\s\S]|[^`\\])*+`"""
# Signs of a shadow: angle brackets around type arguments, and openings that are never closed. Such characters in a
# text itself become a fourth one.
_OPEN_TYPES, _CLOSE_TYPES, _UNCLOSED, _FOREIGN = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"
_NO_SIGNS = str.maketrans(dict.fromkeys(_OPEN_TYPES + _CLOSE_TYPES + _UNCLOSED, _FOREIGN))
_SIGNS = re.compile(rf"{_TEXTS}|[()\[\]{{}}<>;]|&&|\|\||(?<![^\S\n])[^\S\n]*+\n\s*+")
_BRACKETS = re.compile(rf"{_TEXTS}|[()\[\]{{}}]")
_WORD = re.compile(r"[\w$]")


def shadow(content: str) -> str:
    """The content with its pairs made visible; every character keeps its place.

    Angle brackets around type arguments become signs of their own: the opening follows a name at once, the closing is
    no arrow, and between them brackets are balanced, no statement ends, and lines break only beside ``<>,|&``.
    Opening brackets that are never closed become blanks, as nothing can match from them.
    """
    signs: dict[int, str] = {}
    waiting: list[tuple[str, int]] = []

    def leave_types() -> None:
        while waiting and waiting[-1][0] == "<":
            waiting.pop()

    # Only type arguments ask for more than brackets and quotes.
    for match in (_SIGNS if "<" in content else _BRACKETS).finditer(content):
        sign, at = match[0], match.start()
        if sign in "([{":
            waiting.append((sign, at))
        elif sign in _PAIRS:
            leave_types()
            if waiting and waiting[-1][0] == _PAIRS[sign]:
                waiting.pop()
        elif sign == "<":
            if at and _WORD.match(content, at - 1) and content[at + 1 : at + 2] not in ("", " ", "\t", "=", "<"):
                waiting.append((sign, at))
        elif sign == ">":
            if waiting and waiting[-1][0] == "<" and content[at - 1] not in "=-":
                signs[waiting.pop()[1]], signs[at] = _OPEN_TYPES, _CLOSE_TYPES
        elif sign[0] not in "\"'`":
            carried_on = "\n" in sign and (content[at - 1 : at] in tuple("<,|&") or content[match.end() : match.end() + 1] in tuple(">,|&"))
            if not carried_on:
                leave_types()
    signs.update((at, _UNCLOSED) for sign, at in waiting if sign != "<")
    shown = content if content.isascii() else content.translate(_NO_SIGNS)
    if signs:
        shown = list(shown)
        for at, sign in signs.items():
            shown[at] = sign
    return "".join(shown)


# The parts of an expression in a shadow; brackets and quotes nest to any depth. A call to a named part stores the state of
# every group and repetition of the pattern, so only what holds itself is called, and quotes only where one stands.
_QUOTE = r"""(?=["'`])(?&quoted)"""
_BRACKETED = r"\((?&inside)\)|\[(?&inside)\]|\{(?&inside)\}"
_TYPES = f"{_OPEN_TYPES}(?&inside){_CLOSE_TYPES}"
_PARTS = rf"""(?(DEFINE)(?<quoted>{_TEXTS})(?<inside>(?:[^()\[\]{{}}"'`{_OPEN_TYPES}{_CLOSE_TYPES}]++|{_QUOTE}|{_BRACKETED}|{_TYPES}|["'`])*+))"""
_PRIMARY = rf"(?:[-+!~*&]|(?:await|new|typeof|mut|dyn|keyof|readonly)\s)*+(?:[@\#]?[\p{{L}}_$][\w$]*+|\d[\w.]*+|{_QUOTE}|{_BRACKETED})"
_POSTFIX = rf"\s*+(?:\?\.|\.|::|->)\s*+[\p{{L}}_$\d][\w$]*+!?|{_BRACKETED}|{_TYPES}"
_OPERATOR = r"\s*+(?:\|\||&&|\?\?|[=!]==?|<=|>=|<<|>>|\*\*|[-+*/%|&^<>])\s*+"
_EXPRESSION = {
    True: f"{_PRIMARY}(?:{_POSTFIX}|{_OPERATOR}{_PRIMARY})*+",
    False: f"{_PRIMARY}(?:{_OPERATOR}{_PRIMARY}|{_POSTFIX})*?",
}
_IDENTIFIER = r"[\p{L}_$][\w$]*+"
#: Words after which a hole is a name.
NAMING = frozenset("class interface enum struct trait function func fn def type union namespace module".split())


def _run(after: str, enclosed: bool) -> str:
    """Any run of text up to the next template token.

    Within brackets of the template it is balanced and may go over lines; outside them, and up to a quote, it ends
    with the line.
    """
    if after in _PAIRS:
        o, c = re.escape(_PAIRS[after]), re.escape(after)
        return rf"(?:[^{o}{c}\"'`]++|{_QUOTE}|{o}(?&inside){c}|[\"'`])*+"
    if not after:
        return r"[^\n]*"
    if not enclosed or after in "\"'`":
        return r"[^\n]*?"
    return rf"(?:[^()\[\]{{}}\"'`{_OPEN_TYPES}{_CLOSE_TYPES}]|{_QUOTE}|{_BRACKETED}|{_TYPES}|[\"'`])*?"


def _enclosed(tokens: list[str]) -> list[bool]:
    """For each template token, whether brackets of the template are around it."""
    depth, found = 0, []
    for token in tokens:
        depth -= token in _PAIRS
        found.append(depth > 0)
        depth += token in _PAIRS.values()
    return found


def _closed(tokens: list[str], at: int) -> bool:
    """Whether an opening bracket of a template has its closing one outside quotes."""
    depth = 0
    for token in tokens[at:]:
        depth += (token == tokens[at]) - (_PAIRS.get(token) == tokens[at])
        if not depth:
            return True
    return False


def template_regex(template: str) -> tuple[str, dict[str, int]]:
    """A pattern for a code-like template, and the number of each named hole's group.

    ``$NAME`` is one expression (a name after a word like ``class``), ``$$$NAME`` any run, ``$_`` and ``$$$`` are
    unnamed; a repeated name must repeat its text. Blanks between tokens are flexible.
    """
    tokens = re.findall(r"\$\$\$[A-Z_][A-Z0-9_]*|\$\$\$|\$[A-Z_][A-Z0-9_]*|[^\W\d]\w*|\d+|\s+|[^\w\s]", template.strip())
    names: dict[str, int] = {}
    rx, enclosed = "", _enclosed(tokens)
    for i, token in enumerate(tokens):
        before, after = (tokens[i - 1] if i else ""), next((t for t in tokens[i + 1 :] if t.strip()), "")
        if token.isspace():
            wordy = re.match(r"[\w$]", after) and re.search(r"\w$", before) and "$$$" not in before + after[:3]
            rx += r"\s+" if wordy else r"\s*"
            continue
        if i and not before.isspace():
            rx += "" if re.match(r"\w", token) and re.match(r"\w", before) else r"\s*"
        if re.fullmatch(r"\$(?:\$\$)?[A-Z_][A-Z0-9_]*|\$\$\$", token):
            name = token.lstrip("$")
            word = next((t for t in reversed(tokens[:i]) if t.strip()), "")
            if token.startswith("$$$"):
                body = _run(after, enclosed[i])
            else:
                body = _IDENTIFIER if word in NAMING else _EXPRESSION[not after]
            if name in names:
                rx += rf"(?P=h{names[name]})"
            elif name.strip("_"):
                names[name] = len(names) + 1
                rx += f"(?P<h{names[name]}>{body})"
            else:
                rx += f"(?:{body})"
        elif token in ("<", ">"):
            rx += f"[{token}{_OPEN_TYPES if token == '<' else _CLOSE_TYPES}]"
        elif token in _PAIRS.values() and not _closed(tokens, i):
            rx += f"[{re.escape(token)}{_UNCLOSED}]"
        else:
            rx += re.escape(token)
    if re.match(r"[\w$]", tokens[0]) and not tokens[0].startswith("$$$"):
        rx = r"(?<![\w$])" + rx
    if re.match(r"\w", tokens[-1]):
        rx += r"(?![\w$])"
    return _PARTS + rx, names


@functools.cache
def _compiled(rx: str) -> regex.Pattern:
    return regex.compile(rx)


def find_templates(content: str, rx: str, names: dict[str, int], selector: str | None) -> dict[str, list]:
    return find_each_template(content, [(rx, names, selector, "")])[0]


def find_each_template(content: str, forms: list[tuple[str, dict[str, int], str | None, str]]) -> list[dict[str, list]]:
    """What each form (pattern, names, selector, a word it needs) finds; the pairs are made visible once for all."""
    shade, matched, found = shadow(content), {}, []
    for rx, names, selector, word in forms:
        if rx not in matched:
            matched[rx] = [m.regs for m in _compiled(rx).finditer(shade)] if word in content else []
        number = _compiled(rx).groupindex
        groups = {n: number[f"h{k}"] for n, k in names.items()}
        shown = [content[slice(*spans[groups[selector] if selector else 0])] for spans in matched[rx]]
        holes = [{n: content[slice(*spans[g])] for n, g in groups.items()} for spans in matched[rx] if names]
        found.append({"shown": shown, "holes": holes})
    return found


def template_extract(content: Column, template: str, selector: str | None = None) -> Column:
    """The artifact of a template rule: whole matches, or only the hole ``selector`` of a wider context template.

    Hole values of each match are the context.
    """
    return template_extracts(content, [(template, selector)])[0]


def template_extracts(content: Column, templates: list[tuple[str, str | None]]) -> list[Column]:
    """The artifacts of several templates (with the selector or None) on one content, which is looked through once."""
    forms = []
    for template, selector in templates:
        rx, names = template_regex(template)
        if selector is not None and selector not in names:
            raise ValueError(f"Selector {selector!r} is not a hole of the context template")
        # A text without the template's longest word or sign cannot match.
        fixed = [t for t in re.findall(r"\$+[A-Z_][A-Z0-9_]*|\$\$\$|[^\W\d]\w*|\d+|[^\w\s]", template) if not t.startswith("$")]
        forms.append((rx, names, selector, max(fixed, key=len, default="")))

    @F.pandas_udf("array<struct<shown:array<string>,holes:array<map<string,string>>>>")
    def found(contents: pd.Series) -> pd.Series:
        empty = [{"shown": [], "holes": []}] * len(forms)
        return pd.Series([empty if text is None else find_each_template(text, forms) for text in contents], dtype=object)

    likely = reduce(lambda a, b: a | b, [F.contains(content, F.lit(word)) for *_, word in forms])

    def shown(m: Column) -> Column:
        maps = F.filter(F.transform(m["holes"], lambda h: F.map_filter(h, lambda _, v: v != "")), lambda h: F.size(h) > 0)
        return artifact(F.array_join(m["shown"], "\n\n"), F.array(F.to_json(maps)))

    each = found(F.when(likely, content))
    return [or_empty(bind(each[i], shown), content) for i in range(len(forms))]
