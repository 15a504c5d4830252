"""Registered queries over the test tables, each with its DuckDB twin where SQL can say it."""

from castwise.catalog import corpora, flows, listings, scripts, selections, summaries  # noqa: F401
from castwise.catalog import gates, lifecycle  # noqa: F401  (their twins quote those of the others)
from castwise.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
