"""Rule tables from configuration documents.

A configuration has ``concerns`` (name -> signals) and ``defined`` (reusable signals, watches, reports). A
signal has a watch, a report and notify channels; each of signal, watch and report may be a ``use`` reference.
The functions work on a table with one configuration document (JSON text) per row.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fields of a watch that are not parameters of its extractor.
WATCH_FIELDS = ("use", "type", "include")


def config_document(config: dict | str) -> str:
    """A configuration as JSON text; a string is the path of a JSON or YAML file."""
    if isinstance(config, str):
        with open(config, encoding="utf-8") as file:
            text = file.read()
        if config.endswith((".yml", ".yaml")):
            try:
                import yaml
            except ImportError as error:
                raise RuntimeError("reading YAML needs the yaml package; use JSON instead") from error
            config = yaml.safe_load(text)
        else:
            config = json.loads(text)
    if not isinstance(config, dict) or not isinstance(config.get("concerns"), dict):
        raise ValueError("a configuration needs 'concerns'")
    return json.dumps(config, ensure_ascii=False)


def config_table(spark: SparkSession, config: dict | str) -> DataFrame:
    return spark.createDataFrame([(config_document(config),)], "config string")


def _object(text: Column) -> Column:
    """Members of a JSON object as ``map<string,string>``; nested values stay JSON text."""
    return F.from_json(text, "map<string,string>")


def _signal_columns(signal: Column) -> list[Column]:
    parts = _object(signal)
    return [
        F.try_element_at(parts, F.lit("use")).alias("signal_use"),
        F.try_element_at(parts, F.lit("watch")).alias("watch"),
        F.try_element_at(parts, F.lit("report")).alias("report"),
        F.try_element_at(parts, F.lit("notify")).alias("notify"),
    ]


def signal_table(df: DataFrame, keys: list[str], config: str) -> DataFrame:
    """Signals as declared: ``concern_id, concern_pos, signal_pos, signal_use, watch, report, notify`` (JSON texts)."""
    concerns = F.map_entries(_object(F.get_json_object(F.col(config), "$.concerns")))
    rows = df.select(*keys, F.posexplode(concerns).alias("concern_pos", "c"))
    signals = F.from_json(F.get_json_object("c.value", "$.signals"), "array<string>")
    rows = rows.select(
        *keys,
        F.col("c.key").alias("concern_id"),
        "concern_pos",
        F.posexplode(signals).alias("signal_pos", "signal"),
    )
    return rows.select(*keys, "concern_id", "concern_pos", "signal_pos", *_signal_columns(F.col("signal")))


def definition_table(df: DataFrame, keys: list[str], config: str) -> DataFrame:
    """Reusable definitions: ``kind, name, body`` (JSON text)."""
    defined = F.map_entries(_object(F.get_json_object(F.col(config), "$.defined")))
    rows = df.select(*keys, F.explode(defined).alias("d"))
    rows = rows.select(*keys, F.col("d.key").alias("kind"), F.explode(F.map_entries(_object(F.col("d.value")))).alias("e"))
    return rows.select(*keys, "kind", F.col("e.key").alias("name"), F.col("e.value").alias("body"))


def include_list(include: Column) -> Column:
    """One glob or a list of globs as a list; ``include`` is JSON text of an array, or a plain glob."""
    return F.coalesce(F.from_json(F.when(F.startswith(include, F.lit('["')), include), "array<string>"), F.array(include))


def rule_columns(signals: DataFrame, keys: list[str]) -> DataFrame:
    """Signals with inline watch and report as rules: include, watch_type, params, template, notify."""
    watch, report = _object(F.col("watch")), _object(F.col("report"))

    def field(parts: Column, name: str) -> Column:
        return F.try_element_at(parts, F.lit(name))

    include = F.when(field(watch, "include").isNotNull(), include_list(field(watch, "include")))
    return signals.select(
        *keys,
        "concern_id",
        "concern_pos",
        "signal_pos",
        include.alias("include"),
        field(watch, "type").alias("watch_type"),
        F.map_filter(watch, lambda k, _: ~k.isin(*WATCH_FIELDS)).alias("params"),
        field(report, "type").alias("report_type"),
        field(report, "template").alias("template"),
        F.map_filter(_object(F.col("notify")), lambda _, v: v.isNotNull()).alias("notify"),
    )


def rule_table(df: DataFrame, keys: list[str], config: str) -> DataFrame:
    """Rules of configurations that use no references."""
    return rule_columns(signal_table(df, keys, config), keys)
