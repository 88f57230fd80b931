"""Extractors by watch type, and the place to add more.

An extractor builds a Column: ``fn(content, path, params) -> struct(text, context)``. Parameters are known
when the plan is built, so patterns are literals in it.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column

from ..functions.code import code_extract, template_extract
from ..functions.jsonx import json_extract
from ..functions.regex import regex_extract
from ..functions.xmlx import well_formed, xml_extract

Extractor = Callable[[Column, Column, dict[str, str]], Column]


def _template(content: Column, path: Column, params: dict[str, str]) -> Column:
    if not params.get("language"):
        raise ValueError("a template rule needs a language")
    pattern = params["pattern"]
    if pattern.lstrip().startswith("{") and '"context"' in pattern:
        form = json.loads(pattern)
        return template_extract(content, form["context"], form["selector"])
    return template_extract(content, pattern)


def _xpath(content: Column, path: Column, params: dict[str, str], parsed: Column | None = None) -> Column:
    namespaces = json.loads(params["namespaces"]) if params.get("namespaces") else None
    return xml_extract(content, params["expression"], namespaces, parsed)


def _json(content: Column, path: Column, params: dict[str, str]) -> Column:
    return json_extract(content, **params)


def _regex(content: Column, path: Column, params: dict[str, str]) -> Column:
    return regex_extract(content, params["pattern"], params.get("flags") or "")


def _code(content: Column, path: Column, params: dict[str, str]) -> Column:
    if not params.get("kind"):
        raise ValueError("a code rule needs a kind and a capture; queries on syntax trees are not run")
    return code_extract(content, path, params["kind"], params.get("capture") or "body", params.get("language"))


EXTRACTORS: dict[str, Extractor] = {
    "regex": _regex,
    "jq": _json,
    "xpath": _xpath,
    "tsq": _code,
    "ast-grep": _template,
}

# What all rules of a type read of a content, computed once per side and handed to the extractor as ``parsed``.
PARSERS: dict[str, Callable[[Column], Column]] = {"xpath": well_formed}

# JSON differences carry no line range: their lines are not lines of the file.
WITHOUT_LINE_RANGE = {"jq"}

# Types that find nothing in a content they cannot read; any other may end the job.
WITHOUT_ERRORS = {"regex", "xpath", "ast-grep"}


def register_extractor(name: str, extractor: Extractor, line_range: bool = True) -> None:
    EXTRACTORS[name] = extractor
    PARSERS.pop(name, None)
    WITHOUT_LINE_RANGE.discard(name)
    WITHOUT_ERRORS.discard(name)
    if not line_range:
        WITHOUT_LINE_RANGE.add(name)


def extract(watch_type: str, content: Column, path: Column, params: dict[str, str], parsed: Column | None = None) -> Column:
    if watch_type not in EXTRACTORS:
        raise ValueError(f"Unsupported watch type: {watch_type}")
    more = {} if parsed is None else {"parsed": parsed}
    return EXTRACTORS[watch_type](content, path, params, **more)
