"""Rules as data: an index from parts of paths to globs, so that any number of rules is matched in one pass.

Each glob, with its braces opened, is filed under one key: the literal folders (or the whole path) it starts with, else the
literal file name it ends with, else the literal extension, else nothing. A change looks up its few keys, and the glob's
pattern decides. Only globs without any literal part meet all changes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import effective_path, glob_regex, glob_variants
from ..session import checkpointed
from .reports import MAX_BROADCAST_BYTES, Rule

#: The key of globs that any path may match.
ANY = "any"
_WILD = re.compile(r"[*?\[\\{!+@#]")
_GLOB = "rule_no int, key string, pattern string, negated boolean, before array<struct<pattern:string,negated:boolean>>"


def glob_key(glob: str) -> str:
    """The key that every path matching the glob looks up."""
    if glob[:1] in ("!", "#"):
        return ANY
    segments = glob.split("/")
    literal = next((i for i, s in enumerate(segments) if _WILD.search(s)), len(segments))
    if literal == len(segments):
        return "path:" + glob
    if literal:
        return "path:" + "/".join(segments[:literal])
    last = segments[-1]
    if not _WILD.search(last):
        return "name:" + last
    ending = re.search(r"(\.[^.*?\[\\{!+@#\]}()]+)$", last)
    return "ending:" + ending[1] if ending else ANY


def _filed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The globs of each rule with their keys, patterns and what comes before them in the rule."""
    names = [c.split()[0] for c in _GLOB.split(", ")]
    for batch in batches:
        rows = []
        for number, include in zip(batch["rule_no"], batch["include"]):
            before: list[dict] = []
            for glob in (v for g in include for v in glob_variants(g)):
                pattern, negated = glob_regex(glob)
                rows.append((number, glob_key(glob), pattern, negated, list(before)))
                before.append({"pattern": pattern, "negated": negated})
        yield pd.DataFrame(rows, columns=names)


def rule_index(rules: DataFrame) -> DataFrame:
    """The index of rules (rule_no, include), written once: one row per glob."""
    return checkpointed(rules.select(F.col("rule_no").cast("int"), "include").mapInPandas(_filed, _GLOB))


def index_of(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The index of rules in a list; their numbers are their positions."""
    rows = [(i, list(r.include)) for i, r in enumerate(rules)]
    return rule_index(spark.createDataFrame(rows, "rule_no int, include array<string>"))


def path_keys(path: Column) -> Column:
    """The keys of a path: each folder above it and itself, its name, and each ending of its name from a dot on."""
    parts = F.split(path, "/")
    starts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.lit("path:"), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    name = F.element_at(parts, -1)
    dot = F.regexp_extract(name, r"(\.[^.]+)$", 1)
    return F.array_distinct(F.concat(starts, F.array(F.concat(F.lit("name:"), name)), F.array(F.concat(F.lit("ending:"), dot))))


def match_rule_index(changes: DataFrame, index: DataFrame) -> DataFrame:
    """One row per change and matching rule, with ``rule_no``: the rows of ``match_rules``.

    An index of up to 64 MB is sent to all tasks, so changes stay where they are; a larger one is joined by key, and
    adaptive execution splits the keys that many changes have. Globs that any path may match meet every change without
    a shuffle. A rule that matches by several globs counts once, by the first of them.
    """
    columns = changes.columns
    size = F.octet_length(F.concat_ws(" ", "key", "pattern", F.transform("before", lambda b: b["pattern"]))) + 32
    sizes = index.groupBy((F.col("key") == ANY).alias("loose")).agg(F.sum(size).alias("bytes")).collect()  # two rows at most
    held = {r["loose"]: r["bytes"] for r in sizes}
    rows = changes.withColumn("__path", effective_path(F.col("new_path"), F.col("old_path")))
    entries = index.select("rule_no", F.col("key").alias("__key"), *[F.col(c).alias(f"__{c}") for c in ("pattern", "negated", "before")])

    def small(side: DataFrame, loose: bool) -> DataFrame:
        return F.broadcast(side) if held.get(loose, 0) <= MAX_BROADCAST_BYTES else side

    keyed = rows.withColumn("__key", F.explode(path_keys(F.col("__path"))))
    found = [keyed.join(small(entries.where(F.col("__key") != ANY), False), "__key").drop("__key")]
    if True in held:
        found.append(rows.crossJoin(small(entries.where(F.col("__key") == ANY).drop("__key"), True)))
    path = F.col("__path")
    # What a condition decides by is a pattern in the row, so it is no literal.
    hit = F.regexp_like(path, F.col("__pattern")) != F.col("__negated")
    again = F.exists("__before", lambda b: F.regexp_like(path, b["pattern"]) != b["negated"])
    hits = [f.where(hit & ~again).select(*columns, "rule_no") for f in found]
    return hits[0] if len(hits) == 1 else hits[0].unionByName(hits[1])
