"""All registered queries."""

from . import diffs, extraction, joins, reporting  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
