"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into two segments of 32 bits. If two fingerprints differ in at most 3 bits, they differ
in at most one bit in one of the segments. So each segment's value is put into a table, each fingerprint looks up
the 33 values in the ball of radius 1 around its own segment, and what it finds is compared in full.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .components import components

WIDTH = 3
SEED = 42
MAX_BITS = 3
#: A table entry with more fingerprints is cut up further by the other segment's halves.
HOT_ENTRY = 500


def fingerprint(text: str | None) -> int:
    """The fingerprint as a signed 64-bit number: ASCII is lower-cased, words are cut at ASCII white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + WIDTH]) for i in range(max(1, len(words) - WIDTH + 1))]
    total, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(shingles), 65_536):  # a text of any length needs little memory
        hashes = np.array([digest(s, SEED) for s in shingles[at : at + 65_536]], ">u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    bits = np.packbits(2 * total > len(shingles)).tobytes()
    return int.from_bytes(bits, "big", signed=True)


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def _segment(value: Column, number: int) -> Column:
    return F.shiftrightunsigned(value, 32 * number).bitwiseAND(F.lit(0xFFFFFFFF))


def _ball(value: Column, bits: int) -> Column:
    """The values that differ from ``value`` in at most one of the low bits."""
    return F.concat(F.array(value), *[F.array(value.bitwiseXOR(F.lit(1 << i))) for i in range(bits)])


def _keys(values: list[Column], bits: int, ball: bool, number: str, value: str) -> Column:
    """One struct (number of the value, value) for each value, or for each in the ball around it."""

    def each(n: int, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(n).alias(number), v.alias(value)))

    return F.concat(*[each(n, _ball(v, bits) if ball else F.array(v)) for n, v in enumerate(values)])


def _entries(prints: DataFrame, ball: bool) -> DataFrame:
    """fp, segment number, value: what is in the table, or what is looked up."""
    segments = [_segment(F.col("fp"), n) for n in (0, 1)]
    return prints.select("fp", F.explode(_keys(segments, 32, ball, "n", "value")).alias("e")).select("fp", "e.*")


def _cut(rows: DataFrame, ball: bool) -> DataFrame:
    """Entries with a further key from the other segment: its 16-bit halves, or the ball of radius 1 around each."""
    other = F.when(F.col("n") == 0, _segment(F.col("fp"), 1)).otherwise(_segment(F.col("fp"), 0))
    halves = [other.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(other, 16)]
    return rows.select("fp", "n", "value", F.explode(_keys(halves, 16, ball, "k", "half")).alias("e")).select(
        "fp", "n", "value", "e.*"
    )


def links(prints: DataFrame, hot_entry: int = HOT_ENTRY) -> DataFrame:
    """a, b (a < b): the distinct fingerprints ``fp`` that differ in at most 3 bits.

    The same rows come out for any ``hot_entry``: the rest of 3 bits splits over the halves of the other segment in
    the same way as over the segments, so cutting a large entry loses nothing.
    """
    table, asked = _entries(prints, ball=False), _entries(prints, ball=True)
    sizes = table.groupBy("n", "value").agg(F.count("*").alias("size")).where(F.col("size") > hot_entry)
    hot = written(sizes.select("n", "value"), "simhash-hot")
    near = F.expr(f"q.fp < t.fp AND bit_count(q.fp ^ t.fp) <= {MAX_BITS}")
    if hot.isEmpty():
        found = asked.alias("q").join(table.alias("t"), F.expr("q.n = t.n AND q.value = t.value") & near)
        return found.select(F.col("q.fp").alias("a"), F.col("t.fp").alias("b"))
    keys = ["n", "value"]
    cold = asked.join(hot, keys, "left_anti").alias("q").join(
        table.join(hot, keys, "left_anti").alias("t"), F.expr("q.n = t.n AND q.value = t.value") & near
    )
    cut = _cut(asked.join(hot, keys, "left_semi"), ball=True).alias("q").join(
        _cut(table.join(hot, keys, "left_semi"), ball=False).alias("t"),
        F.expr("q.n = t.n AND q.value = t.value AND q.k = t.k AND q.half = t.half") & near,
    )
    pairs = [f.select(F.col("q.fp").alias("a"), F.col("t.fp").alias("b")) for f in (cold, cut)]
    return pairs[0].union(pairs[1])


def _placed(docs: DataFrame, id_column: str, text_column: str, hot_entry: int) -> DataFrame:
    """doc_id, fp, component (its least fingerprint), component_id (its least doc_id)."""
    prints = written(
        docs.select(F.col(id_column).cast("bigint").alias("doc_id"), fingerprints(F.col(text_column)).alias("fp")), "simhash-prints"
    )
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    label = components(links(nodes.select("fp"), hot_entry))
    placed = nodes.join(label, nodes.fp == label.node, "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    smallest = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    placed = placed.join(smallest, "component").select(F.col("fp").alias("node"), "component", "component_id")
    return prints.join(placed, prints.fp == placed.node).drop("node")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", hot_entry: int = HOT_ENTRY) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Equal fingerprints are one node, so a group of copies of any size costs one node. NULL and empty texts have
    fingerprint zero, which is linked like any other. NULL ids are never the smallest unless a component has no
    other. Rows with the same id may lie in several components. An empty table gives no rows. Only the id and the
    text are read, so other columns may have any name.
    """
    found = _placed(docs, id_column, text_column, hot_entry)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each component with all its columns: the one with the smallest id, and of these the smallest print."""
    found = _placed(docs, id_column, text_column, HOT_ENTRY)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp"))
    keep = found.groupBy("component").agg(first.alias("first"))
    keep = written(keep.select(F.col("first.doc_id").alias("__keep_id"), F.col("first.fp").alias("__fp")), "simhash-kept")
    same = docs[id_column].cast("bigint").eqNullSafe(F.col("__keep_id"))
    ids = docs.select(F.col(id_column).cast("bigint").alias("id"))
    if ids.groupBy("id").count().where("count > 1").isEmpty():
        return docs.join(keep, same, "left_semi")
    # Some ids repeat, so the fingerprint has to tell which of their rows stays, and one of equal rows.
    same = same & (fingerprints(docs[text_column]) == F.col("__fp"))
    return docs.join(keep, same).dropDuplicates(["__keep_id", "__fp"]).drop("__keep_id", "__fp")
