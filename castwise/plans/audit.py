"""Listings and the run audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castwise import params as P
from castwise.functions import text
from castwise.functions.clock import iso
from castwise.operators.ranking import top


def latest_content(content: DataFrame, limit: int = 50) -> DataFrame:
    """The newest items in the shape a client reads."""
    rows = top(content, [F.col("created_at").desc(), F.col("id").desc()], limit)
    return rows.select(
        "id", text.or_else(F.col("title"), F.col("topic")).alias("title"), "topic", "category", "status",
        "quality_score", F.col("video_format").alias("format"), iso(F.col("created_at")).alias("created_at"),
    )


def top_topics(topics: DataFrame, limit: int = 50) -> DataFrame:
    rows = top(topics, [F.col("total").desc(), F.col("topic_id")], limit)
    return rows.select("topic_id", text.or_else(F.col("angle"), F.col("topic")).alias("label"), "category", "total", "status")


def recent_runs(runs: DataFrame, limit: int = 40) -> DataFrame:
    rows = top(runs, [F.col("created_at").desc(), F.col("id").desc()], limit)
    return rows.select("id", "run_id", "agent", "status", "duration_ms", iso(F.col("created_at")).alias("created_at"))


def run_counts(runs: DataFrame) -> DataFrame:
    return runs.groupBy("agent", "status").agg(
        F.count("*").alias("runs"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("total_ms")
    )


def audit_rows(calls: DataFrame) -> DataFrame:
    """Stored form of finished calls: payload and output cut to a summary."""
    return calls.select(
        "run_id", "agent", "status", "duration_ms", "attempts",
        text.summary(F.col("payload")).alias("input_summary"), text.summary(F.col("output")).alias("output_summary"),
    )


def unknown_statuses(content: DataFrame) -> DataFrame:
    """Rows whose status is none of the life-cycle values."""
    bad = F.col("status").isNull() | ~F.col("status").isin(*P.CONTENT_STATUSES)
    return content.filter(bad).groupBy("status").agg(F.count("*").alias("rows"))


def missing(expected: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` that are expected and not stored."""
    return expected.select(key).distinct().join(stored.select(key), key, "left_anti")
