"""Comparing snapshots: change rows, exact renames, attached versions, tree status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .ordered import HOT_ROWS, ranked


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def compare_snapshots(base: DataFrame, head: DataFrame, keys: list[str], content: str) -> DataFrame:
    """Keys, ``type`` (add, delete, modify, same) and both content hashes for every key of either side.

    Only keys and hashes are shuffled. A key must be unique within a snapshot.
    """
    b = base.select(*keys, content_hash(F.col(content)).alias("old_hash"), F.lit(True).alias("in_base"))
    h = head.select(*keys, content_hash(F.col(content)).alias("new_hash"), F.lit(True).alias("in_head"))
    kind = (
        F.when(F.col("in_base").isNull(), "add")
        .when(F.col("in_head").isNull(), "delete")
        .when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "same")
        .otherwise("modify")
    )
    return b.join(h, keys, "full").select(*keys, kind.alias("type"), "old_hash", "new_hash")


def snapshot_diff(base: DataFrame, head: DataFrame, keys: list[str], content: str) -> DataFrame:
    """The changed keys of two snapshots: added, deleted and modified rows."""
    return compare_snapshots(base, head, keys, content).where(F.col("type") != "same")


def detect_renames(status: DataFrame, path: str = "path", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Change rows with exact renames and copies, from the result of ``compare_snapshots``.

    An added row whose content equals a deleted row is a rename; both sides of a group of equal contents are
    paired in path order, so each deleted row is used once. An added row left over whose content equals an
    unchanged row is a copy of the smallest such path. Groups of copies of any size are ranked in pieces.
    """
    # Several branches read the comparison; the narrow result is written once instead of hashing again.
    status = checkpointed(status)
    adds = status.where("type = 'add'").select(F.col(path).alias("new_path"), F.col("new_hash").alias("hash"))
    gone = status.where("type = 'delete'").select(F.col(path).alias("old_path"), F.col("old_hash").alias("hash"))
    # A content and a rank name one row on each side, so a large group of copies spreads over all tasks. One full
    # join tells what was renamed and what is left on either side.
    matched = ranked(adds, ["hash"], ["new_path"], hot_rows=hot_rows).join(
        ranked(gone, ["hash"], ["old_path"], hot_rows=hot_rows), ["hash", "rank"], "full"
    )
    sources = (
        status.where("type = 'same'").groupBy(F.col("new_hash").alias("hash")).agg(F.min(path).alias("source"))
    )
    # Only what was added looks for a source; rows without that key keep their own, which no source has.
    added = F.col("old_path").isNull()
    matched = matched.withColumn("wanted", F.when(added, F.col("hash")).otherwise(F.concat(F.lit("-"), "old_path")))
    found = matched.join(sources.withColumnRenamed("hash", "wanted"), "wanted", "left")
    kind = (
        F.when(F.col("new_path").isNull(), "delete")
        .when(~added, "rename")
        .when(F.col("source").isNotNull(), "copy")
        .otherwise("add")
    )
    rows = found.select(F.coalesce("old_path", "source").alias("old_path"), "new_path", kind.alias("type"))
    changed = status.where("type = 'modify'").select(F.col(path).alias("old_path"), F.col(path).alias("new_path"), "type")
    rows = rows.unionByName(changed)
    return rows.withColumn("similarity", F.when(F.col("type").isin("rename", "copy"), F.lit(100)))


def attach_versions(
    changes: DataFrame, snapshots: DataFrame, base: str | Column, head: str | Column, few: bool = False
) -> DataFrame:
    """Old content at (base, old_path) and new content at (head, new_path); a missing side is NULL.

    ``snapshots`` has ``ref, path, content`` with at most one row per (ref, path). ``base`` and ``head`` may be
    names or columns of ``changes``; a name reads only that ref's rows. The old side is looked up unless the row
    is an add, the new side unless it is a delete.

    ``few`` promises that the paths of ``changes`` are few enough to broadcast: contents nobody asked for are
    then dropped where they are read, and only the wanted ones are shuffled.

    Contents are always merged: sizes are estimated from compressed columns, far below what texts made of them take,
    and a broadcast by such an estimate brings all contents to the driver.
    """
    def attach(rows: DataFrame, side: str, ref: str | Column, absent: str) -> DataFrame:
        found = snapshots.select(
            F.col("ref").alias("__ref"), F.col("path").alias("__path"), F.col("content").alias(f"{side}_content")
        )
        # Rows without this side keep a path as key, which spreads them; a NULL key would put them into one task.
        own, other = F.col(f"{side}_path"), F.col("old_path" if side == "new" else "new_path")
        rows = rows.withColumn("__key", F.coalesce(own, other)).withColumn(
            "__look", own.isNotNull() & (F.col("type") != absent)
        )
        on = (F.col("__key") == F.col("__path")) & F.col("__look")
        names = [F.col("__key").alias("__path")]
        if isinstance(ref, str):
            found = found.where(F.col("__ref") == ref)
        else:
            rows = rows.withColumn("__wanted", ref)
            on = on & (F.col("__wanted") == F.col("__ref"))
            names.append(F.col("__wanted").alias("__ref"))
        if few:
            wanted = rows.where("__look").select(*names).distinct()
            found = found.join(F.broadcast(wanted), wanted.columns, "left_semi")
        return rows.join(found.hint("merge"), on, "left").drop("__ref", "__path", "__key", "__look", "__wanted")

    return attach(attach(changes, "new", head, "delete"), "old", base, "add").select(
        *changes.columns, "old_content", "new_content"
    )


def lookup(requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Content for (ref, path) requests; NULL when there is none."""
    return requests.join(snapshots.hint("merge"), ["ref", "path"], "left")


def valid_refs(changes: DataFrame, refs: DataFrame, column: str = "ref") -> DataFrame:
    """The change rows whose ref exists. The empty ref and ``.`` never do."""
    known = refs.where(~F.col("ref").isin("", "."))
    # Rows that can never match stay out of the shuffle, where they would all meet.
    named = changes.where(~F.col(column).isin("", "."))
    return named.join(known.select(F.col("ref").alias(column)), column, "left_semi")


def invalid_refs(changes: DataFrame, refs: DataFrame, column: str = "ref") -> DataFrame:
    """The refs of change rows that do not exist, once each."""
    known = refs.where(~F.col("ref").isin("", "."))
    return changes.select(column).distinct().join(known.select(F.col("ref").alias(column)), column, "left_anti")


def tree_status(head: DataFrame, index: DataFrame, working: DataFrame, repo: str, keys: list[str], content: str):
    """Per repository: has_staged (head and index differ), has_unstaged (index and working differ), is_clean.

    The three snapshots meet in one aggregation on the key, so no pair of them is joined twice.
    """
    cols = [repo, *keys]
    sides = [
        df.select(*cols, *[(content_hash(F.col(content)) if s == i else F.lit(None).cast("string")).alias(f"h{i}") for i in range(3)],
                  *[F.lit(s == i).alias(f"p{i}") for i in range(3)])
        for s, df in enumerate((head, index, working))
    ]
    merged = (
        sides[0].unionByName(sides[1]).unionByName(sides[2])
        .groupBy(*cols)
        .agg(*[F.max(f"h{i}").alias(f"h{i}") for i in range(3)], *[F.bool_or(f"p{i}").alias(f"p{i}") for i in range(3)])
    )

    def differ(i: int, j: int) -> Column:
        return (F.col(f"p{i}") != F.col(f"p{j}")) | ~F.col(f"h{i}").eqNullSafe(F.col(f"h{j}"))

    status = merged.groupBy(repo).agg(
        F.bool_or(differ(0, 1)).alias("has_staged"), F.bool_or(differ(1, 2)).alias("has_unstaged")
    )
    return status.select("*", (~F.col("has_staged") & ~F.col("has_unstaged")).alias("is_clean"))
