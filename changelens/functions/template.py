"""Report templates: ``{{name}}`` substitution and HTML escaping."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Escaped characters, ampersand first.
HTML_ENTITIES = {
    "&": "&amp;",
    "<": "&lt;",
    ">": "&gt;",
    '"': "&quot;",
    "'": "&#x27;",
    "`": "&#x60;",
    "=": "&#x3D;",
}


def html_escape(text: Column) -> Column:
    for char, entity in HTML_ENTITIES.items():
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


_HOLE = re.compile(r"\{\{(\{|~?&)?~?\s*([^{}]*?)\s*~?\}?\}\}")


def render(template: str, values: dict[str, Column], escaped: tuple[str, ...] = ("filePath",)) -> Column:
    """The template with its names replaced; unknown names are empty, inserted text is never read as template.

    Names in ``escaped`` are HTML-escaped unless written with three braces or ``&``. A ``~`` takes the blanks on its side.
    """
    parts: list[Column] = []
    end = 0
    for hole in _HOLE.finditer(template):
        before, end = template[end : hole.start()], hole.end()
        parts.append(F.lit(before.rstrip() if re.match(r"\{\{\{?~", hole[0]) else before))
        if re.search(r"~\}?\}\}$", hole[0]):
            end += len(template[end:]) - len(template[end:].lstrip())
        name = hole[2].removeprefix("this.")
        if name[:1] in ("#", "/", ">", "^", "*") or name == "else":
            raise ValueError(f"Only plain names are supported in templates: {hole[0]}")
        if name in values:
            value = F.coalesce(values[name], F.lit(""))
            parts.append(html_escape(value) if name in escaped and not hole[1] else value)
    parts.append(F.lit(template[end:]))
    return F.concat(*parts)


def render_rows(template: Column, values: Column) -> Column:
    """Substitution where the template is a column too; ``values`` is a map from name to (already escaped) text."""
    hole = r"\{\{\s*([^{}]*?)\s*\}\}"
    texts = F.split(template, hole, -1)
    names = F.regexp_extract_all(template, F.lit(hole), F.lit(1))
    filled = F.zip_with(
        texts,
        names,
        lambda text, name: F.concat(text, F.when(name.isNull(), "").otherwise(F.coalesce(F.try_element_at(values, name), F.lit("")))),
    )
    return F.array_join(filled, "")
