"""Resolution of ``use`` references against definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.refs import parse_use


def _targets(rows: DataFrame, use: Column, kind: str, keys: list[str], definitions: DataFrame) -> DataFrame:
    """Rows with the parsed reference and the body it names (NULL if there is none).

    The two are merged: bodies parsed out of configurations take far more than is estimated for a broadcast.
    """
    parsed = rows.withColumn("__use", use).withColumn("__ref", parse_use(F.col("__use")))
    named = parsed.select("*", F.when(F.col("__ref.kind") == kind, F.col("__ref.name")).alias("__name"))
    known = definitions.where(F.col("kind") == kind).select(*keys, F.col("name").alias("__name"), F.col("body").alias("__body"))
    return named.join(known.hint("merge"), [*keys, "__name"], "left")


def resolve_column(rows: DataFrame, column: str, use: Column, kind: str, keys: list[str], definitions: DataFrame):
    """Replace ``column`` by the body of the definition where ``use`` is set; wrong kinds and unknown names are errors."""
    found = _targets(rows, use, kind, keys, definitions)
    wrong = F.raise_error(F.concat(F.lit(f"Expected a reference to {kind}, got "), F.col("__use"))).cast("string")
    unknown = F.raise_error(F.concat(F.lit("Not found in definitions: "), F.col("__use"))).cast("string")
    value = (
        F.when(F.col("__use").isNull(), F.col(column))
        .when(F.col("__ref.kind") != kind, wrong)
        .otherwise(F.coalesce("__body", unknown))
    )
    others = [c for c in rows.columns if c != column]
    return found.select(*others, value.alias(column))


def _use_of(part: str) -> Column:
    return F.get_json_object(F.col(part), "$.use")


def resolve_refs(signals: DataFrame, definitions: DataFrame, keys: list[str]) -> DataFrame:
    """Signals with every reference replaced; a referenced signal may itself use watch and report definitions."""
    rows = signals.withColumn("__signal", F.lit(None).cast("string"))
    rows = resolve_column(rows, "__signal", F.col("signal_use"), "signals", keys, definitions)
    for part in ("watch", "report", "notify"):
        rows = rows.withColumn(part, F.when(F.col("signal_use").isNull(), F.col(part)).otherwise(F.get_json_object("__signal", f"$.{part}")))
    rows = resolve_column(rows, "watch", _use_of("watch"), "watches", keys, definitions)
    rows = resolve_column(rows, "report", _use_of("report"), "reports", keys, definitions)
    return rows.select(*keys, "concern_id", "concern_pos", "signal_pos", "watch", "report", "notify")


def unresolved_refs(uses: DataFrame, use: str, definitions: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose reference names no definition, with its kind and name."""
    parsed = uses.withColumn("__ref", parse_use(F.col(use))).where(F.col("__ref").isNotNull())
    parsed = parsed.select(*uses.columns, F.col("__ref.kind").alias("kind"), F.col("__ref.name").alias("name"))
    return parsed.join(definitions.select(*keys, "kind", "name"), [*keys, "kind", "name"], "left_anti")
