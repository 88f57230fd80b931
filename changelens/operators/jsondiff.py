"""JSON documents as rows: key-level differences and node tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonx import json_object
from ..session import checkpointed
from .rows import one_row_each


def json_entry_diff(df: DataFrame, keys: list[str], old: str, new: str) -> DataFrame:
    """``json_key, change, old_value, new_value`` for added, removed and changed top-level keys.

    Both objects are in the row, so their entries are matched there and nothing is shuffled.
    """
    empty = F.create_map().cast("map<string,string>")
    pairs = F.map_zip_with(
        F.coalesce(json_object(F.col(old)), empty),
        F.coalesce(json_object(F.col(new)), empty),
        lambda _, a, b: F.struct(a.alias("old_value"), b.alias("new_value")),
    )
    changed = F.map_filter(pairs, lambda _, v: ~v["old_value"].eqNullSafe(v["new_value"]))
    rows = one_row_each(df.where(~F.col(old).eqNullSafe(F.col(new))), keys, F.map_entries(changed), "e")
    rows = rows.select(*keys, F.col("e.key").alias("json_key"), F.col("e.value").alias("v"))
    change = (
        F.when(F.col("v.old_value").isNull(), "added").when(F.col("v.new_value").isNull(), "removed").otherwise("changed")
    )
    return rows.select(*keys, "json_key", change.alias("change"), "v.old_value", "v.new_value")


#: Levels that are opened in one plan. Documents that nest deeper take more rounds, and only what is open goes on.
LEVELS = 4
_NODE = "struct<path:string,node:variant,open:boolean>"


def json_nodes(df: DataFrame, keys: list[str], content: str, levels: int = LEVELS) -> DataFrame:
    """``path, kind, value`` of every node of the documents; objects and arrays have no value.

    Each level opens the containers of the level before it inside the row. After some levels the nodes are written
    down, and those still closed over something go into the next round, so one deep document costs the others nothing.
    """

    def is_open(v: Column) -> Column:
        return F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)")

    def make(path: Column, v: Column, opened: Column) -> Column:
        return F.struct(path.alias("path"), v.alias("node"), opened.alias("open"))

    def opened(rows: DataFrame) -> DataFrame:
        n = F.col("n")
        fields = F.transform(
            F.map_entries(F.try_variant_get(n["node"], "$", "map<string,variant>")),
            lambda e: make(F.concat(n["path"], F.lit("."), e["key"]), e["value"], is_open(e["value"])),
        )
        items = F.transform(
            F.try_variant_get(n["node"], "$", "array<variant>"),
            lambda v, i: make(F.concat(n["path"], F.lit("["), i.cast("string"), F.lit("]")), v, is_open(v)),
        )
        itself = F.array(make(n["path"], n["node"], F.lit(False)))
        nothing = F.array().cast(f"array<{_NODE}>")
        grown = F.when(n["open"], F.concat(itself, F.coalesce(fields, items, nothing))).otherwise(itself)
        return one_row_each(rows, keys, grown, "n")

    root = F.parse_json(F.col(content))
    rows, done = df.select(*keys, make(F.lit("$"), root, is_open(root)).alias("n")), []
    while True:
        for _ in range(levels):
            rows = opened(rows)
        rows = checkpointed(rows)
        done.append(rows.where("NOT n.open"))
        rows = rows.where("n.open")
        if rows.isEmpty():
            break
    every = reduce(DataFrame.union, done)
    return every.select(
        *keys,
        F.col("n.path").alias("path"),
        F.regexp_extract(F.schema_of_variant(F.col("n.node")), "^[A-Z]+", 0).alias("kind"),
        F.when(~is_open(F.col("n.node")), F.to_json(F.col("n.node"))).alias("value"),
    )
