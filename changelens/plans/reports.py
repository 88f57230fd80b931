"""From change rows to reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.artifacts import merge_context
from ..functions.paths import effective_path, glob_any, glob_regex
from ..functions.template import render
from ..operators.linediff import with_hunk, with_hunks
from ..operators.references import resolve_refs
from ..operators.rows import one_row_each
from ..operators.snapshots import attach_versions
from ..session import checkpointed
from ..sources.rules import config_table, definition_table, rule_columns, signal_table
from .extractors import PARSERS, WITHOUT_ERRORS, WITHOUT_LINE_RANGE, extract

# Rules go into the plan as literals; a plan holds this many at a time, more make more plans over the same versions.
RULES_PER_PLAN = 256
# Up to this many bytes of watched paths they are broadcast to pick the contents.
MAX_BROADCAST_BYTES = 64 << 20


@dataclass(frozen=True)
class Rule:
    concern_id: str
    concern_pos: int
    signal_pos: int
    include: tuple[str, ...]
    watch_type: str
    params: dict[str, str] = field(default_factory=dict)
    template: str = "{{diffText}}"
    report_type: str = "handlebars"
    notify: dict[str, str] = field(default_factory=dict)


def rules_from(rules: DataFrame) -> list[Rule]:
    """The rules of one configuration, which become part of the plan. A rule that cannot run is refused here."""
    found = [
        Rule(
            r.concern_id,
            r.concern_pos,
            r.signal_pos,
            tuple(r.include),
            r.watch_type,
            dict(r.params or {}),
            r.template,
            r.report_type,
            dict(r.notify or {}),
        )
        for r in rules.orderBy("concern_pos", "signal_pos").collect()
    ]
    for rule in found:
        check_rule(rule)
    return found


def check_rule(rule: Rule) -> None:
    """Build the rule once, so that what it lacks is named together with its place."""
    try:
        extract(rule.watch_type, F.lit(""), F.lit("file.txt"), rule.params)
        for glob in rule.include:
            glob_regex(glob)
    except (KeyError, TypeError, ValueError) as error:
        what = f"{error} is missing" if isinstance(error, KeyError) else str(error)
        raise ValueError(f"concern {rule.concern_id!r}, signal {rule.signal_pos}: {what}") from error


def load_rules(spark: SparkSession, config: dict | str) -> list[Rule]:
    """The rules of a configuration with all references resolved."""
    table = config_table(spark, config)
    resolved = resolve_refs(signal_table(table, [], "config"), definition_table(table, [], "config"), [])
    return rules_from(rule_columns(resolved, []))


def render_report(report_type: str, template: str, values: dict[str, Column]) -> Column:
    if report_type not in RENDERERS:
        raise ValueError(f"Unsupported report type: {report_type}")
    return RENDERERS[report_type](template, values)


RENDERERS: dict[str, Callable[[str, dict[str, Column]], Column]] = {"handlebars": render}


def match_rules(changes: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per change and matching rule (``rule_no`` is its position in ``rules``).

    The rules are literals in one projection, so there is no join and the change table keeps its partitioning.
    """
    path = effective_path(F.col("new_path"), F.col("old_path"))
    hits = F.array(*[F.when(glob_any(path, r.include), F.lit(i)) for i, r in enumerate(rules)])
    return one_row_each(changes, ["*"], F.array_compact(hits), "rule_no")


def both_missing(old: str = "old_content", new: str = "new_content") -> Column:
    return F.col(old).isNull() & F.col(new).isNull()


def apply_watches(versions: DataFrame, rules: list[Rule], keep: list[str]) -> DataFrame:
    """Artifacts of every matching rule that differ between the versions.

    All rules run in one pass over the contents, and only differing artifacts leave the row.
    Result: ``keep, file_path, rule_no, left, right, context``.
    """
    path = effective_path(F.col("new_path"), F.col("old_path"))
    # Paths are tested once for all that asks for them.
    hit = {globs: f"__hit_{i}" for i, globs in enumerate(dict.fromkeys(tuple(r.include) for r in rules))}
    changed = ~F.col("old_content").eqNullSafe(F.col("new_content"))
    tests = [changed.alias("__changed"), *[glob_any(path, globs).alias(name) for globs, name in hit.items()]]
    versions = versions.where(~both_missing()).select("*", *tests)

    def read(some: list[Rule], name: str) -> Column:
        """Where rules of one type read a side: in what they watch, if the sides differ.

        Python functions see all rows, so the contents themselves are withheld. A content that only moved has the same
        artifacts on both sides; where reading it may end the job, one side is read all the same.
        """
        watched = reduce(lambda a, b: a | b, [F.col(hit[tuple(r.include)]) for r in some])
        return watched if name == "old" and some[0].watch_type not in WITHOUT_ERRORS else watched & F.col("__changed")

    for kind, parse in PARSERS.items():
        some = [r for r in rules if r.watch_type == kind]
        if some:
            sides = [F.when(read(some, s), parse(F.col(f"{s}_content"))).alias(f"__{kind}_{s}") for s in ("old", "new")]
            versions = versions.select("*", *sides)

    def side(rule: Rule, name: str) -> Column:
        parsed = F.col(f"__{rule.watch_type}_{name}") if rule.watch_type in PARSERS else None
        content = F.when(read([rule], name), F.col(f"{name}_content"))
        return extract(rule.watch_type, content, path, rule.params, parsed)

    def pair(i: int, rule: Rule) -> Column:
        sides = F.struct(F.lit(i).alias("rule_no"), side(rule, "old").alias("l"), side(rule, "new").alias("r"))
        return F.when(F.col(hit[tuple(rule.include)]), sides)

    pairs = F.array(*[pair(i, r) for i, r in enumerate(rules)])
    fired = F.filter(pairs, lambda p: F.col("__changed") & p.isNotNull() & (p["l"]["text"] != p["r"]["text"]))
    rows = one_row_each(versions, [*keep, path.alias("file_path")], fired, "p")
    return rows.select(
        *keep,
        "file_path",
        "p.rule_no",
        F.col("p.l.text").alias("left_artifact"),
        F.col("p.r.text").alias("right_artifact"),
        merge_context(F.col("p.l.context"), F.col("p.r.context")).alias("context"),
    )


def _by_rule(rules: list[Rule], value: Callable[[Rule], Column]) -> Column:
    column = F.when(F.lit(False), value(rules[0]))
    for i, rule in enumerate(rules):
        column = column.when(F.col("rule_no") == i, value(rule))
    return column


def _with_diff(fired: DataFrame, hunks: str) -> DataFrame:
    if hunks == "one":
        out = with_hunk(fired, "left_artifact", "right_artifact")
        first = F.col("hunk")
        return out.withColumn("line_start", first["new_start"]).withColumn(
            "line_end", first["new_start"] + first["new_lines"] - 1
        ).drop("hunk")
    if hunks != "anchored":
        raise ValueError(f"Unknown diff form: {hunks}")
    out = with_hunks(fired, "left_artifact", "right_artifact")
    first = F.col("hunks")[0]
    return out.select(
        *fired.columns,
        F.array_join(F.transform("hunks", lambda h: h["hunk_text"]), "").alias("diff_text"),
        first["new_start"].alias("line_start"),
        (first["new_start"] + first["new_lines"] - 1).alias("line_end"),
    )


def report_rows(fired: DataFrame, keys: list[str], rules: list[Rule], hunks: str = "one") -> DataFrame:
    """Report rows with rendered messages; fields that are not set are NULL."""
    out = _with_diff(fired, hunks)
    values = {
        "diffText": F.col("diff_text"),
        "filePath": F.col("file_path"),
        "left.artifact": F.col("left_artifact"),
        "right.artifact": F.col("right_artifact"),
    }
    ranged = [i for i, r in enumerate(rules) if r.watch_type not in WITHOUT_LINE_RANGE]
    in_file = F.col("rule_no").isin(*ranged) if ranged else F.lit(False)
    channels = [
        (r.notify or {}) for r in rules
    ]
    notify = F.lit(None).cast("map<string,string>")
    for i, c in enumerate(channels):
        if c:
            literal = F.create_map(*[F.lit(x) for kv in c.items() for x in kv])
            notify = F.when(F.col("rule_no") == i, literal).otherwise(notify)
    return out.select(
        *keys,
        _by_rule(rules, lambda r: F.lit(r.concern_id)).alias("concern_id"),
        _by_rule(rules, lambda r: F.lit(r.concern_pos)).alias("concern_pos"),
        _by_rule(rules, lambda r: F.lit(r.signal_pos)).alias("signal_pos"),
        F.col("file_path").alias("file_name"),
        _by_rule(rules, lambda r: render_report(r.report_type, r.template, values)).alias("message"),
        "diff_text",
        "left_artifact",
        "right_artifact",
        F.when(in_file, F.col("line_start")).alias("line_start"),
        F.when(in_file, F.col("line_end")).alias("line_end"),
        "context",
        notify.alias("notify"),
    )


def run_rules(
    changes: DataFrame,
    snapshots: DataFrame,
    rules: list[Rule],
    keys: list[str],
    base: str | Column,
    head: str | Column,
    hunks: str = "one",
) -> DataFrame:
    """Changes + snapshots + rules -> reports.

    ``keys`` identify and order a change row. Paths are tested on the narrow change table first, and the
    watched changes are written down: finding them is the expensive part, and their number decides how the
    contents are fetched.
    """
    if not rules:
        raise ValueError("no rules")
    path = effective_path(F.col("new_path"), F.col("old_path"))
    watched_by = [glob_any(path, r.include) for r in rules]
    changes = checkpointed(changes.where(reduce(lambda a, b: a | b, watched_by)))
    size = changes.agg(F.sum(F.octet_length(F.concat_ws(" ", "old_path", "new_path")) + 16)).first()[0] or 0
    versions = attach_versions(changes, snapshots, base, head, size <= MAX_BROADCAST_BYTES)
    if len(rules) > RULES_PER_PLAN:
        versions = checkpointed(versions)  # several plans read the contents; they are joined once
    plans = []
    for start in range(0, len(rules), RULES_PER_PLAN):
        some = rules[start : start + RULES_PER_PLAN]
        plans.append(report_rows(apply_watches(versions, some, keys), keys, some, hunks))
    return reduce(lambda a, b: a.unionByName(b), plans)


def order_reports(reports: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """By file, then concern, then signal; only sinks need an order.

    A global sort reads its input twice (once for the range borders), so the reports are written down first, with
    the given columns beside those of the order.
    """
    if columns is not None:
        reports = reports.select(*dict.fromkeys([*keys, "concern_pos", "signal_pos", *columns]))
    return checkpointed(reports).orderBy(*keys, "concern_pos", "signal_pos")


def report_metadata() -> Column:
    """The record of a report for sinks, with absent fields NULL."""
    span = F.when(
        F.col("line_start").isNotNull(), F.struct(F.col("line_end").alias("end"), F.col("line_start").alias("start"))
    )
    return F.struct(
        F.col("diff_text").alias("diffText"),
        F.col("file_name").alias("fileName"),
        "message",
        span.alias("lineRange"),
        F.from_json("context", "array<array<map<string,string>>>").alias("context"),
    )


def collect_reports(reports: DataFrame, keys: list[str]) -> DataFrame:
    """The reports of each changed file as one ordered array: at most one per rule, whatever the data holds."""
    item = F.struct("concern_pos", "signal_pos", report_metadata().alias("metadata"))
    # The context has maps, which do not sort; positions are unique within a file, so they alone decide.
    listed = F.array_sort(
        F.collect_list(item),
        lambda a, b: F.when(
            (a["concern_pos"] < b["concern_pos"])
            | ((a["concern_pos"] == b["concern_pos"]) & (a["signal_pos"] < b["signal_pos"])),
            -1,
        ).otherwise(1),
    )
    return reports.groupBy(*keys).agg(F.transform(listed, lambda r: r["metadata"]).alias("reports"))


def notifications(reports: DataFrame, keys: list[str]) -> DataFrame:
    """One row per report, channel and target; channels that are not set have none."""
    rows = reports.select(*keys, "concern_pos", "signal_pos", "file_name", "message", F.explode("notify").alias("channel", "target"))
    return rows.where(F.col("target").isNotNull())
