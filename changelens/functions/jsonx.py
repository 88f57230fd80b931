"""JSON extraction: path values, keys, entries, deletion, pretty printing, tokens.

Objects are handled as ``map<string,string>`` from key to compact JSON text, in document order.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .artifacts import artifact, bind, or_empty

STRING_TOKEN = r'"(?:[^"\\]|\\.)*+"'


def json_quote(text: Column) -> Column:
    """A string as a JSON string token."""
    wrapped = F.to_json(F.array(text))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


def _variant(content: Column, strict: bool) -> Column:
    return F.parse_json(content) if strict else F.try_parse_json(content)


class _Number(str):
    """A number as it is written."""


def _written(value) -> str:
    """Compact JSON text; numbers as they were written."""
    if isinstance(value, _Number):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_written(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_written, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def keep_last(text: str) -> str:
    """A document in which each object has a key once, with its last value; what is no JSON stays as it is."""
    try:
        return _written(json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_Number))
    except (ValueError, RecursionError):
        return text


@F.pandas_udf(T.StringType())
def _kept_last(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else keep_last(t) for t in texts], dtype=object)


def last_values(content: Column) -> Column:
    """Documents that repeat a key in one object keep its last value; all others stay as they are.

    Variants refuse a repeated key, so a table that may hold such documents goes through this first, in a ``select`` of its
    own. Only what variants refuse is handed to Python.
    """
    refused = content.isNotNull() & content.rlike(r"\S") & F.try_parse_json(content).isNull()
    return F.coalesce(_kept_last(F.when(refused, content)), content)


def json_path(content: Column, path: str, strict: bool = True) -> Column:
    """The value at a path as JSON text; ``null`` when missing. Invalid JSON raises, or is NULL when not strict."""

    def value(doc: Column) -> Column:
        node = F.try_variant_get(doc, path, "variant")
        text = F.when(F.schema_of_variant(node) == "STRING", F.to_json(node)).otherwise(
            F.coalesce(F.get_json_object(content, path), F.lit("null"))
        )
        return F.when(doc.isNotNull(), text)

    return bind(_variant(content, strict), value)


def json_object(text: Column) -> Column:
    """The entries of an object as a map from key to compact JSON text, in document order."""
    raw = F.from_json(text, "map<string,string>")
    typed = F.from_json(text, "map<string,variant>")
    return F.map_zip_with(
        raw,
        typed,
        lambda _, plain, node: F.when(F.schema_of_variant(node) == "STRING", json_quote(plain)).otherwise(
            F.coalesce(F.get_json_object(plain, "$"), F.lit("null"))
        ),
    )


def _at(content: Column, path: str) -> Column:
    return F.get_json_object(content, path)


def json_keys(content: Column, path: str = "$") -> Column:
    """Sorted keys of the object at a path."""
    return F.sort_array(F.array_distinct(F.json_object_keys(_at(content, path))))


def json_del(content: Column, path: str, *keys: str) -> Column:
    """The object at a path without the given keys, as an entry map."""
    return F.map_filter(json_object(_at(content, path)), lambda k, _: ~k.isin(*keys))


def json_entries(content: Column, path: str, prefix: str = "") -> Column:
    """Entries of the object at a path whose key starts with a prefix, as an entry map."""
    return F.map_filter(json_object(_at(content, path)), lambda k, _: F.startswith(k, F.lit(prefix)))


def json_compact(entries: Column) -> Column:
    """An entry map on one line."""
    parts = F.transform(F.map_entries(entries), lambda e: F.concat(json_quote(e["key"]), F.lit(":"), e["value"]))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def json_pretty(entries: Column) -> Column:
    """An entry map with one entry per line and a final newline, so that line differences are per key."""
    lines = F.transform(
        F.map_entries(entries), lambda e: F.concat(F.lit("  "), json_quote(e["key"]), F.lit(": "), e["value"])
    )
    return F.when(F.size(entries) == 0, F.lit("{}\n")).otherwise(
        F.concat(F.lit("{\n"), F.array_join(lines, ",\n"), F.lit("\n}\n"))
    )


def _pretty_list(items: Column) -> Column:
    return F.when(F.size(items) == 0, F.lit("[]\n")).otherwise(
        F.concat(F.lit("[\n"), F.array_join(items, ",\n"), F.lit("\n]\n"))
    )


def json_strings(content: Column) -> Column:
    """All string tokens in document order, keys included."""
    return F.regexp_extract_all(content, F.lit(STRING_TOKEN), F.lit(0))


def json_all_keys(content: Column) -> Column:
    """All object keys at any depth in document order, quotes kept."""
    keys = F.regexp_extract_all(content, F.lit(rf"({STRING_TOKEN})\s*:|{STRING_TOKEN}"), F.lit(1))
    # A string that is no key matches the second branch and leaves the group empty.
    return F.filter(keys, lambda k: k != "")


# The query shapes a JSON rule may use.
_NAME = r"""\.?(?:[A-Za-z_]\w*|"[^"'\\]+"|\["[^"'\\]+"\])"""
_PATH = rf"(?P<path>\.|(?:(?!\w){_NAME}|\.?\[\d+\])+)"
QUERY_SHAPES = {
    "value": _PATH,
    "keys": _PATH + r"\s*\|\s*keys",
    "del": _PATH + rf"\s*\|\s*del\((?P<arg>(?!\w){_NAME}(?:\s*,\s*(?!\w){_NAME})*)\)",
    "entries": _PATH + r'\s*\|\s*to_entries\s*\|\s*map\(select\(\.key\s*\|\s*startswith\("(?P<arg>[^"\\]*)"\)\)\)',
}


def query_shape(query: str) -> dict[str, str]:
    """The parameters of a query text that has one of the supported shapes."""
    for op, shape in QUERY_SHAPES.items():
        found = re.fullmatch(shape, query.strip())
        if found:
            # Quoted names become bracketed ones.
            path = re.sub(r"""\.?\[?"([^"]+)"\]?""", r"['\1']", found["path"]).replace(".[", "[")
            return {"op": op, "path": "$" if path == "." else "$" + path, "arg": found.groupdict().get("arg") or ""}
    raise ValueError(f"Unsupported JSON query {query!r}; give op, path and arg, or register an extractor")


def _names(arg: str) -> list[str]:
    """``.a, ."b-c"`` as names; a plain name stands for itself."""
    return [quoted or plain for quoted, plain in re.findall(r'"([^"]+)"|([\w$-]+)', arg)]


def json_extract(
    content: Column, query: str | None = None, strict: bool = True, repeated_keys: str = "refuse", **params: str
) -> Column:
    """The artifact of a JSON rule: a value, sorted keys, an object without a key, or entries by key prefix.

    ``repeated_keys`` is ``refuse`` (such a document is an error) or ``last`` (the last value counts).
    """
    if repeated_keys not in ("refuse", "last"):
        raise ValueError(f"repeated_keys is refuse or last, not {repeated_keys!r}")
    if repeated_keys == "last":
        return bind(last_values(content), lambda c: json_extract(c, query, strict, **params))
    shape = query_shape(query) if query is not None else {"op": "value", "path": "$", "arg": "", **params}
    path, arg, op = shape["path"], shape["arg"], shape["op"]

    def pair(e: Column) -> Column:
        return F.concat(
            F.lit('  {\n    "key": '), json_quote(e["key"]), F.lit(',\n    "value": '), e["value"], F.lit("\n  }")
        )

    if op == "value":

        def body(value: Column) -> Column:
            # A string value keeps its quotes, so a brace in front means an object, as it stands at the path.
            return F.when(F.startswith(value, F.lit("{")), json_pretty(json_object(value))).otherwise(F.concat(value, F.lit("\n")))

    else:
        if op == "keys":
            text = _pretty_list(F.transform(json_keys(content, path), lambda k: F.concat(F.lit("  "), json_quote(k))))
        elif op == "del":
            text = json_pretty(json_del(content, path, *_names(arg)))
        elif op == "entries":
            text = _pretty_list(F.transform(F.map_entries(json_entries(content, path, arg)), pair))
        else:
            raise ValueError(f"Unknown JSON operation: {op}")

        def body(value: Column) -> Column:
            # The path may hold no object.
            return F.when(value.isNotNull(), F.coalesce(text, F.lit("null\n")))

    text_or_null = bind(json_path(content, path, strict), body)
    has_text = content.rlike(r"\S")
    return or_empty(artifact(F.when(has_text, F.coalesce(text_or_null, F.lit(""))).otherwise(F.lit(""))), content)
