"""Merkle manifest of a table: digest trees per source, one root, and a recursive climb that proves each leaf.

Each row is a leaf. The leaves of a source are numbered in order of their ids without any task seeing a whole source;
runs of 16 become nodes, level by level, which are stored as rows with a link to their parent. A recursive query then
starts at every leaf, appends the siblings it passes and folds its digest with them, up to the root; the leaves of a run
go together, as one row.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Consecutive nodes below one parent.
FAN = 16
#: Characters of a digest.
HEX = 64
#: The number of the tree over the sources' roots; the sources' own trees have the numbers from 0.
TOP = -1
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """A value with its length in bytes before it, so that neighbours cannot be confused; ``-`` for NULL."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: dict[str, Column]) -> Column:
    return digest(F.concat(*[field(c) for c in columns.values()]))


def tampered(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _ordered(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """The rows with ``place``, which ascends with the keys; its upper bits number the range it was sorted in.

    Equal rows are told apart by where they are read, so that a large group of them is split over several ranges.
    """
    rows = rows.withColumn("__read", F.monotonically_increasing_id())
    keys = [*keys, "__read"]
    ranges = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return written(ranges.drop("__read").withColumn("place", F.monotonically_increasing_id()), label)


def _range(place: Column) -> Column:
    return F.shiftright(place, 33)


def _numbered(leaves: DataFrame) -> DataFrame:
    """doc_id, leaf, changed, and: t (number of the source's tree), i (number in it), n (its leaves).

    Only counts by source and range are summed up in order: a source has at most as many as there are ranges.
    """
    rows = _ordered(leaves, ["tree", "doc_id", "leaf"], "merkle-leaves").withColumn("range", _range(F.col("place")))
    spans = written(rows.groupBy("tree", "range").agg(F.min("place").alias("first"), F.count("*").alias("size")), "merkle-spans")
    trees = spans.groupBy("tree").agg(F.sum("size").alias("n"))
    numbers = _ordered(trees, ["tree"], "merkle-trees").withColumn("range", _range(F.col("place")))
    before = F.expr("sum(size) OVER (ORDER BY range) - size AS before")  # as many rows as ranges
    starts = numbers.groupBy("range").agg(F.min("place").alias("first"), F.count("*").alias("size")).select("range", "first", before)
    numbers = numbers.join(starts, "range").select("tree", "n", (F.col("before") + F.col("place") - F.col("first")).alias("t"))
    earlier = F.expr("sum(size) OVER (PARTITION BY tree ORDER BY range) - size AS earlier")
    spans = spans.select("tree", "range", "first", earlier).join(numbers, "tree")
    number = F.col("earlier") + F.col("place") - F.col("first")
    return written(rows.join(spans, ["tree", "range"]).select("doc_id", "leaf", "changed", "t", number.alias("i"), "n"), "merkle-numbered")


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """The levels above nodes (t, i, n, h): t, level, i, n, h and ``below``, the digests of the run, put together."""
    size, levels = nodes.agg(F.max("n")).first()[0] or 0, []
    while size > 1:
        digests = F.expr("array_join(transform(array_sort(collect_list(struct(i, h))), x -> x.h), '') AS below")
        runs = nodes.where("n > 1").groupBy("t", "n", F.expr(f"i DIV {FAN}").alias("run")).agg(digests)
        level = F.lit(len(levels) + 1).alias("level")
        up = F.expr(f"(n + {FAN - 1}) DIV {FAN}").alias("n")
        nodes = written(runs.select("t", level, F.col("run").alias("i"), up, digest(F.col("below")).alias("h"), "below"), "merkle-level")
        levels.append(nodes)
        size = -(-size // FAN)
    return levels


def _linked(nodes: DataFrame, sources: int) -> DataFrame:
    """With the parent (up_t, up_level, up_i) and the place among its children (at), from t, level, i and n.

    A source's root is a leaf of the tree over the sources; the last root has no parent.
    """
    inner, joined = F.col("n") > 1, (F.col("t") != TOP) & F.lit(sources > 1)
    number = F.when(inner, F.col("i")).when(joined, F.col("t"))
    rows = nodes.withColumn("number", number)
    return rows.select(
        *nodes.columns,
        F.when(inner, F.col("t")).when(joined, F.lit(TOP).cast("bigint")).alias("up_t"),
        F.when(inner, F.col("level") + 1).when(joined, F.lit(1)).alias("up_level"),
        F.expr(f"number DIV {FAN}").alias("up_i"),
        (F.col("number") % FAN).cast("int").alias("at"),
    )


CLIMB = """
WITH RECURSIVE climb AS (
  SELECT t, i, up_t, up_level, up_i, at, 1 AS spread, folded, '' AS seen FROM {{runs}}
  UNION ALL
  SELECT c.t, c.i, n.up_t, n.up_level, n.up_i, n.at, 0 AS spread,
    transform(c.folded, (h, k) -> sha2(CAST(
      left(n.below, {hex} * (c.at + c.spread * k)) || h || substr(n.below, {hex} * (c.at + c.spread * k) + {hex} + 1) AS BINARY), 256)),
    CASE WHEN c.spread = 1 THEN n.below
         ELSE c.seen || left(n.below, {hex} * c.at) || substr(n.below, {hex} * c.at + {hex} + 1) END
  FROM climb c JOIN {{nodes}} n ON c.up_t = n.t AND c.up_level = n.level AND c.up_i = n.i
)
SELECT t, i DIV {fan} AS run, folded, seen FROM climb WHERE up_t IS NULL
""".format(fan=FAN, hex=HEX)


def _climbed(runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """t, run, the folded digests of its leaves at the root (an array) and what they have ``seen``: the run's digests
    and then the siblings on the way.

    The leaves of a run climb as one row: on the first step each is folded at its own place among the others, from
    there on they pass the same nodes. So a step moves a sixteenth of the rows, and siblings are kept once a run.
    """
    spark = runs.sparkSession
    was = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")  # as many rows as runs, at every level
    try:
        return written(spark.sql(CLIMB, runs=runs, nodes=nodes), "merkle-climbed")
    finally:
        spark.conf.set(ROW_LIMIT, was)


def manifest(
    docs: DataFrame,
    columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    source: str = "source",
    id_column: str = "doc_id",
    tampering: tuple[Column, dict[str, Column]] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``tampering`` is a condition and what then replaces columns; the digest of such a row is folded with the siblings of
    the untampered trees, so ``verified`` is false where anything really changed.

    NULL is written ``-``, which no value is. NULL ids come first, then ids ascend; rows that share an id follow the order
    of their digests, and equal rows are leaves of their own. A lone leaf is its source's root, a lone source's root is
    the root; a leaf without siblings has the digest of nothing as its proof. An empty table gives no rows. Texts of any
    length are read once, to digest them. Only the named columns are read, so others may have any name.
    """
    values = {c: docs[c] for c in columns}
    own, changed = leaf(values), F.lit(None).cast("string")
    if tampering is not None:
        condition, replaced = tampering
        changed = F.when(condition, leaf(values | replaced))
    # Sources in bytewise order, NULL before all.
    tree = F.coalesce(F.concat(F.lit("."), docs[source].cast("string")), F.lit("-"))
    rows = docs.select(docs[id_column].alias("doc_id"), tree.alias("tree"), own.alias("leaf"), changed.alias("changed"))
    leaves = _numbered(written(rows, "merkle-digests"))

    levels = _levels(leaves.select("t", "i", "n", F.col("leaf").alias("h")))
    tops = [leaves.where("n = 1").select("t", F.col("leaf").alias("h"))] + [x.where("n = 1").select("t", "h") for x in levels]
    subroots = written(functools.reduce(DataFrame.union, tops), "merkle-subroots")
    sources = subroots.count()
    top = subroots.select(F.lit(TOP).cast("bigint").alias("t"), F.col("t").alias("i"), F.lit(sources).cast("bigint").alias("n"), "h")
    levels += (upper := _levels(top))
    root = (upper[-1] if upper else subroots).select("h").first()
    root = F.lit(root["h"] if root else None).cast("string")

    links = ["t", "level", "i", "below", "up_t", "up_level", "up_i", "at"]
    nodes = [_linked(x.drop("h"), sources).select(*links) for x in levels]
    nodes = functools.reduce(DataFrame.union, nodes) if nodes else leaves.sparkSession.createDataFrame(
        [], "t bigint, level int, i bigint, below string, up_t bigint, up_level int, up_i bigint, at int"
    )
    folded = F.expr("transform(array_sort(collect_list(struct(i, h))), x -> x.h) AS folded")
    start = leaves.select("t", "i", "n", F.coalesce("changed", "leaf").alias("h")).groupBy("t", "n", F.expr(f"i DIV {FAN}").alias("run")).agg(folded)
    start = _linked(start.select("t", F.lit(0).alias("level"), (F.col("run") * FAN).alias("i"), "n", "folded"), sources)
    climbed = _climbed(start.select("t", "i", "up_t", "up_level", "up_i", "at", "folded"), written(nodes, "merkle-nodes"))

    runs = climbed.join(subroots.withColumnRenamed("h", "subroot"), "t")
    found = leaves.withColumn("run", F.expr(f"i DIV {FAN}")).join(runs, ["t", "run"])
    own = F.expr(f"folded[CAST(i % {FAN} AS INT)]")
    place = F.expr(f"CAST({HEX} * IF(n > 1, i % {FAN}, t % {FAN}) AS INT)")
    others = F.concat(F.left("seen", place), F.substring("seen", place + HEX + 1, F.length("seen")))
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        root.alias("root"),
        digest(others).alias("proof_sha256"),
        own.alias("folded_root"),
        (own == root).alias("verified"),
    )
