"""Report sinks: JSON documents and messages in report order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.reports import collect_reports, order_reports


def reports_json(reports: DataFrame, keys: list[str]) -> DataFrame:
    """One ``{"reports":[...]}`` document per changed file; fields that are not set are left out."""
    return collect_reports(reports, keys).select(*keys, F.to_json(F.struct("reports")).alias("json"))


def reports_text(reports: DataFrame, keys: list[str]) -> DataFrame:
    """The rendered messages in report order, with the keys to order by."""
    return order_reports(reports, keys, ["message"])


def write_json(reports: DataFrame, folder: str) -> None:
    """One JSON object per report and line."""
    reports.write.mode("errorifexists").json(folder)


def write_text(reports: DataFrame, keys: list[str], folder: str) -> None:
    """The messages only, in report order across the part files."""
    reports_text(reports, keys).select("message").write.mode("errorifexists").text(folder)
