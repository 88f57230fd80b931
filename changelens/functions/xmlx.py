"""XPath extraction that never fails on malformed XML."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .artifacts import artifact, bind, or_empty
from .pairing import outermost, pairs

_PROLOG = r"^\s*(?:<\?xml[^>]*\?>)?(?:\s++|<!--[\s\S]*?-->|<\?[\s\S]*?\?>|<!DOCTYPE[^>\[]*(?:\[[^\]]*\]\s*)?>)*+"


def _is_sound(body: Column) -> Column:
    """Whether a text without prolog is one well-formed element.

    The text is wrapped into a fresh root, so the parser sees all of it. Mostly the root's name then opens
    once and its closing tag ends the text; otherwise the children of the fresh root are counted.
    """
    wrapped = F.concat(F.lit("<whole>"), body, F.lit("</whole>"))
    parsed = F.from_xml(
        wrapped, "broken string", {"columnNameOfCorruptRecord": "broken", "mode": "PERMISSIVE", "rowTag": "whole"}
    )
    single = F.xpath_boolean(wrapped, F.lit("count(/whole/*)=1 and not(/whole/text()[normalize-space()])"))

    def one_root(root: Column) -> Column:
        once = F.regexp_count(body, F.concat(F.lit("</?"), root, F.lit(r"[\s/>]"))) == 2
        ended = F.endswith(F.rtrim(body, F.lit(" \t\r\n")), F.concat(F.lit("</"), root, F.lit(">")))
        return ((root != "") & once & ended) | single

    root = F.regexp_extract(body, r"^<([\w:.\-]+)", 1)
    return (body != "") & parsed["broken"].isNull() & bind(root, one_root)


def well_formed(content: Column) -> Column:
    """The document without prolog when it is one well-formed element, else NULL."""
    return bind(F.regexp_replace(content, _PROLOG, ""), lambda body: F.when(_is_sound(body), body))


def map_namespaces(expr: str, namespaces: dict[str, str] | None) -> str:
    """Steps with a mapped prefix match by local name, with any prefix or the default namespace."""
    for prefix in namespaces or {}:
        step = rf"(?<![\w:.\-]){re.escape(prefix)}:([A-Za-z_][\w.\-]*)"
        pieces = re.split(r"(\"[^\"]*\"|'[^']*')", expr)
        expr = "".join(
            p if p[:1] in "\"'" and p else re.sub(step, r"*[name()='\1' or substring-after(name(),':')='\1']", p)
            for p in pieces
        )
    return expr


def xpath_value(
    content: Column, expr: str, kind: str = "string", namespaces: dict[str, str] | None = None, sound: Column | None = None
) -> Column:
    """A string, number or boolean result as text; '' for malformed input. ``sound``: what ``well_formed`` gave."""
    path = F.lit(map_namespaces(expr, namespaces))
    body = well_formed(content) if sound is None else sound
    if kind == "string":
        text = F.xpath_string(body, path)
    elif kind == "boolean":
        text = F.xpath_boolean(body, path).cast("string")
    elif kind == "number":

        def shown(number: Column) -> Column:
            whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
            return F.when(whole, number.cast("bigint").cast("string")).otherwise(number.cast("string"))

        text = bind(F.xpath_number(body, path), shown)
    else:
        raise ValueError(f"Unknown XPath result kind: {kind}")
    return F.coalesce(text, F.lit(""))


def xpath_nodes(
    content: Column, expr: str, namespaces: dict[str, str] | None = None, sound: Column | None = None
) -> Column:
    """What all selected nodes hold, in document order, one item per line; '' for malformed input.

    Attributes and text nodes give their value, elements the values of all attributes and texts inside them, so a
    change anywhere below a selected element shows.
    """
    nodes = f"({map_namespaces(expr, namespaces)})"
    inside = f"{nodes}/descendant-or-self::*/@* | {nodes}/descendant::text()[normalize-space()] | {nodes}[not(self::*)]"
    return F.coalesce(F.array_join(F.xpath(well_formed(content) if sound is None else sound, F.lit(inside)), "\n"), F.lit(""))


def _markup_pieces(name: str) -> str:
    """The text cut into comments, marked sections, opening and closing tags of one name, and what lies between."""
    attributes = r"""(?:[^<>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
    other = rf"(?:[^<]++|<(?!/?+{name}[\s/>]|!--|!\[CDATA\[))++"
    return rf"(?s)<!--.*?(?:-->|\z)|<!\[CDATA\[.*?(?:\]\]>|\z)|<{name}(?=[\s/>]){attributes}>|</{name}\s*+>|{other}|<"


def element_markup(content: Column, tag: str) -> Column:
    """Elements with their tags, in order; works on HTML as well.

    An element that holds others of its name comes once and whole. Tags in comments and marked sections do not count,
    nor do those that are never closed or never opened; NULL stays NULL.
    """
    name = re.escape(tag)

    def elements(pieces: Column) -> Column:
        opens, closes = rf"^<{name}[\s/>]", rf"^</{name}\s*+>"
        opened = lambda p: F.when(F.endswith(p, F.lit("/>")), 2).otherwise(1)
        kinds = F.transform(pieces, lambda p: F.when(p.rlike(closes), -1).when(p.rlike(opens), opened(p)).otherwise(0))
        return bind(kinds, lambda kind: cut(pieces, kind))

    def cut(pieces: Column, kinds: Column) -> Column:
        single = F.filter(F.transform(kinds, lambda k, i: F.when(k == 2, F.struct(i.alias("first"), i.alias("last")))), lambda e: e.isNotNull())
        paired = pairs(F.transform(kinds, lambda k: F.when(k == 2, 0).otherwise(k)))
        return F.transform(
            outermost(F.sort_array(F.concat(paired, single))),
            lambda p: F.array_join(F.slice(pieces, p["first"] + 1, p["last"] - p["first"] + 1), ""),
        )

    return bind(F.regexp_extract_all(content, F.lit(_markup_pieces(name)), F.lit(0)), elements)


def xpath_kind(expression: str, namespaces: dict[str, str] | None = None) -> str | None:
    """string, number, boolean or nodes; None for what is no XPath expression. Compiled once, on the driver."""
    jvm = SparkSession.active()._jvm
    empty = jvm.javax.xml.parsers.DocumentBuilderFactory.newInstance().newDocumentBuilder().newDocument()
    try:
        compiled = jvm.javax.xml.xpath.XPathFactory.newInstance().newXPath().compile(map_namespaces(expression, namespaces))
        kind = compiled.evaluateExpression(empty).type().name()
    except Py4JJavaError:
        return None
    return {"STRING": "string", "NUMBER": "number", "BOOLEAN": "boolean"}.get(kind, "nodes")


def xml_extract(
    content: Column, expression: str, namespaces: dict[str, str] | None = None, sound: Column | None = None
) -> Column:
    """The artifact of an XPath rule: the value of the expression, or the nodes listed; '' for a bad expression."""
    kind = xpath_kind(expression, namespaces)
    if kind is None:
        text = F.lit("")
    elif kind == "nodes":
        text = xpath_nodes(content, expression, namespaces, sound)
    else:
        text = xpath_value(content, expression, kind, namespaces, sound)
    return or_empty(artifact(text), content)
