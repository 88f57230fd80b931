"""Renames of edited rows: a similarity join on lines and a one-to-one assignment.

Exact renames are taken first, by hash (``detect_renames``). What is left of added and deleted rows is compared by the
sets of their lines. Rows with the same lines are one class, so a group of copies of any size is compared once. Lines
are put in one order, seldom ones first: two sets that share at least half of the longer one also share a line of the first
half of each, so only such lines have to meet. A class and its best partner are then taken together, round by round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, stored
from .ordered import HOT_ROWS, ranked
from .snapshots import compare_snapshots, detect_renames

#: Lines that more than this many different texts hold say nothing about where a text comes from.
COMMON = 1_000
_SIDES = ("old", "new")


def line_hashes(content: Column) -> Column:
    """The different lines of a text that are not empty, as sorted hashes."""
    lines = F.filter(F.split(content, "\n"), lambda line: line != "")
    return F.array_sort(F.array_distinct(F.transform(lines, lambda line: F.xxhash64(line))))


def _classes(left: DataFrame) -> DataFrame:
    """side, first (least path), members, id (digest of the lines), lines; from side, path, lines."""
    named = left.where(F.size("lines") > 0).withColumn("id", F.sha2(F.array_join(F.col("lines").cast("array<string>"), ","), 256))
    return named.groupBy("side", "id").agg(
        F.min("path").alias("first"), F.count(F.lit(1)).alias("members"), F.any_value("lines").alias("lines")
    )


def similar_pairs(classes: DataFrame, common: int = COMMON) -> DataFrame:
    """old, new (ids of classes) and similarity, from 50 on: shared lines in percent of the longer side."""
    tokens = classes.select("side", "id", F.explode("lines").alias("line"))
    counts = tokens.groupBy("line").agg(F.count(F.lit(1)).alias("texts"))
    seldom = tokens.join(counts.where(F.col("texts") <= common), "line")
    sets = seldom.groupBy("side", "id").agg(F.array_sort(F.collect_list(F.struct("texts", "line"))).alias("lines"))
    sets = checkpointed(sets.select("side", "id", F.transform("lines", lambda x: x["line"]).alias("lines"), F.size("lines").alias("n")))
    # Half of the lines, and one more, hold one that is shared.
    first = sets.select("side", "id", "n", F.posexplode(F.slice("lines", F.lit(1), (F.col("n") / 2).cast("int") + 1)).alias("at", "line"))
    old, new = (first.where(F.col("side") == s).select(F.col("id").alias(s), F.col("n").alias(f"{s}_n"), F.col("at").alias(f"{s}_at"), "line") for s in _SIDES)
    room = F.least(F.col("old_n") - F.col("old_at"), F.col("new_n") - F.col("new_at")) * 2 >= F.greatest("old_n", "new_n")
    met = old.join(new, "line").where(room).select("old", "new").distinct()
    for side in _SIDES:
        own = sets.where(F.col("side") == side).select(F.col("id").alias(side), F.col("lines").alias(f"{side}_lines"))
        met = met.join(own, side)
    shared = F.size(F.array_intersect("old_lines", "new_lines"))
    longer = F.greatest(F.size("old_lines"), F.size("new_lines"))
    pairs = met.select("old", "new", F.floor(100 * shared / longer).cast("int").alias("similarity")).where(F.col("similarity") >= 50)
    # Texts of the same lines are alike, also where all of these are common.
    same = classes.groupBy("id").agg(F.count_distinct("side").alias("sides")).where("sides = 2")
    same = same.select(F.col("id").alias("old"), F.col("id").alias("new"), F.lit(100).alias("similarity"))
    return pairs.where("old <> new").unionByName(same)


def assign(pairs: DataFrame) -> DataFrame:
    """One-to-one assignment: old, new, old_from, new_from, times, similarity.

    ``pairs`` has old, new, similarity, old_first, new_first (a path of each) and old_left, new_left (how many members are
    left). The best pair is the most similar one, then one of equal file names, then the one with the least digest of its
    paths; pairs that are the best of both their sides are taken at once, with as many members as both have, and the rest
    goes on. With digests, n classes that are all equally alike need about log n rounds; in path order they would need n.
    """
    rest, taken = stored(pairs.withColumn("old_from", F.lit(0)).withColumn("new_from", F.lit(0))), []
    name = {s: F.regexp_extract(f"{s}_first", "[^/]*$", 0) for s in _SIDES}
    paths = F.concat("old_first", F.lit("\n"), "new_first")
    rank = F.struct((-F.col("similarity")).alias("s"), (name["old"] != name["new"]).alias("named"), F.md5(paths.cast("binary")).alias("d"))
    while not rest.isEmpty():
        rows = rest.withColumn("rank", rank)
        best = rows
        for side in _SIDES:
            least = rows.groupBy(side).agg(F.min("rank").alias("least"))
            best = best.join(least, side).where(F.col("rank") == F.col("least")).drop("least")
        best = stored(best.withColumn("times", F.least("old_left", "new_left").cast("int")).drop("rank"))
        taken.append(best.select("old", "new", "old_from", "new_from", "times", "similarity"))
        for side in _SIDES:
            used = best.select(side, F.col("times").alias("used"))
            rest = rest.join(used, side, "left").withColumn("used", F.coalesce("used", F.lit(0)))
            rest = rest.withColumn(f"{side}_left", F.col(f"{side}_left") - F.col("used"))
            rest = rest.withColumn(f"{side}_from", F.col(f"{side}_from") + F.col("used")).drop("used")
        rest = stored(rest.where("old_left > 0 AND new_left > 0"))
    if not taken:
        return rest.withColumn("times", F.lit(0)).select("old", "new", "old_from", "new_from", "times", "similarity")
    found = taken[0]
    for more in taken[1:]:
        found = found.unionByName(more)
    return found


def similar_renames(base: DataFrame, head: DataFrame, path: str = "path", content: str = "content", common: int = COMMON, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Change rows of two snapshots with exact and inexact renames: old_path, new_path, type, similarity.

    Similarity is the number of different lines both texts hold, in percent of the longer text's, rounded down; from 50 on a
    deleted and an added row are one renamed row. Each row is used once: the most similar pair of classes of equal lines comes
    first (ties: see ``assign``), and members follow by path. Empty lines, and lines that more than ``common``
    different texts hold, are not counted; NULL and empty texts are no renames unless they are equal.
    """
    moves = checkpointed(detect_renames(compare_snapshots(base, head, [path], content), path, hot_rows))
    open_, sides = {"old": moves.where("type = 'delete'"), "new": moves.where("type = 'add'")}, []
    for side, snapshot in zip(_SIDES, (base, head)):
        asked = open_[side].select(F.col(f"{side}_path").alias(path))
        rows = snapshot.join(asked, path, "left_semi")
        sides.append(rows.select(F.lit(side).alias("side"), F.col(path).alias("path"), line_hashes(F.col(content)).alias("lines")))
    left = checkpointed(sides[0].unionByName(sides[1]))
    classes = checkpointed(_classes(left))
    pairs = similar_pairs(classes, common)
    for side in _SIDES:
        own = classes.where(F.col("side") == side)
        pairs = pairs.join(own.select(F.col("id").alias(side), F.col("first").alias(f"{side}_first"), F.col("members").alias(f"{side}_left")), side)
    taken = checkpointed(assign(pairs))

    each = taken.select("old", "new", "old_from", "new_from", "similarity", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("k"))
    each = each.select("old", "new", (F.col("old_from") + F.col("k")).alias("old_at"), (F.col("new_from") + F.col("k")).alias("new_at"), "similarity")
    member = left.where(F.size("lines") > 0).select("side", "path", F.sha2(F.array_join(F.col("lines").cast("array<string>"), ","), 256).alias("id"))
    member = ranked(member, ["side", "id"], ["path"], hot_rows=hot_rows)
    for side in _SIDES:
        own = member.where(F.col("side") == side).select(F.col("id").alias(side), (F.col("rank") - 1).cast("int").alias(f"{side}_at"), F.col("path").alias(f"{side}_path"))
        each = each.join(own, [side, f"{side}_at"])
    renamed = checkpointed(each.select("old_path", "new_path", F.lit("rename").alias("type"), "similarity"))
    rest = [open_[s].join(renamed.select(f"{s}_path"), f"{s}_path", "left_anti").select(moves.columns) for s in _SIDES]
    return moves.where("type NOT IN ('add', 'delete')").unionByName(renamed).unionByName(rest[0]).unionByName(rest[1])
