"""Review bundles: queue, decisions, approved runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castwise.functions import text
from castwise.operators.joins import insert_if_absent, keyed_update
from castwise.operators.sequences import positions

DECISIONS = ("approved", "rejected")
PUBLISHED = ("published", "dry_run")


def bundles(items: DataFrame) -> DataFrame:
    """A pending record per produced item (run_id, content_id, title, category, format, quality_passed, scorecard)."""
    return items.withColumn("review_status", F.lit("pending"))


def mark_in_review(content: DataFrame, records: DataFrame) -> DataFrame:
    """Content with a bundle waits in review, unless it is published already."""
    ids = records.select(F.col("content_id").alias("id")).distinct().withColumn("__bundle", F.lit(True))
    waiting = F.col("__bundle").isNotNull() & (F.col("status") != "published")
    return content.join(ids, "id", "left").withColumn(
        "status", F.when(waiting, "in_review").otherwise(F.col("status"))
    ).drop("__bundle")


def decide(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply the latest decision per run: (run_id, review_status, reviewed_at)."""
    order = [F.col("reviewed_at").desc(), F.col("review_status")]
    return keyed_update(records, decisions, "run_id", ["review_status"], order)


def apply_to_content(content: DataFrame, records: DataFrame) -> DataFrame:
    """Approved and rejected records set the status of their content."""
    changes = records.filter(F.col("review_status").isin(*DECISIONS)).select(
        F.col("content_id").alias("id"), F.col("review_status").alias("status")
    )
    return keyed_update(content, changes, "id", ["status"], [F.col("status")])


def listing(records: DataFrame) -> DataFrame:
    """The queue as a reviewer sees it; sort by run_id to display."""
    return records.select(
        "run_id", "review_status",
        F.coalesce("format", F.lit("-")).alias("format"),
        F.coalesce(F.try_element_at("scorecard", F.lit("overall")).cast("string"), F.lit("-")).alias("overall"),
        F.left(F.coalesce("title", F.lit("")), F.lit(44)).alias("title"),
    )


def approved_runs(records: DataFrame, checkpoints: DataFrame, run_id: str | None = None) -> DataFrame:
    """Approved records (of one run, if given) whose checkpoint exists."""
    rows = records.filter(F.col("review_status") == "approved")
    if run_id is not None:
        rows = rows.filter(F.col("run_id") == run_id)
    return rows.join(checkpoints.select("run_id"), "run_id", "left_semi")


def publish(records: DataFrame, results: DataFrame, at: Column) -> DataFrame:
    """Records of the runs that were published (or tried as a dry run) become published, with the time.

    ``results`` has a row per run and platform with its ``status``; other runs keep their records.
    """
    done = results.filter(F.col("status").isin(*PUBLISHED)).select("run_id").distinct()
    changes = done.select("run_id", F.lit("published").alias("review_status"), at.alias("published_at"))
    return keyed_update(records, changes, "run_id", ["review_status", "published_at"])


def publish_content(content: DataFrame, records: DataFrame) -> DataFrame:
    """Content of published records: status and the date of the first publication."""
    done = records.filter(F.col("review_status") == "published").groupBy(F.col("content_id").alias("id")).agg(
        F.lit("published").alias("status"), F.min("published_at").alias("published_date"))
    return keyed_update(content, done, "id", ["status", "published_date"])


def schedule(records: DataFrame, slots: DataFrame) -> DataFrame:
    """Tags the pending records with the dates of the chosen slots: the n-th record by run_id gets the n-th slot.

    ``slots`` has (batch_position, date) of one batch; records beyond it keep no date.
    """
    waiting = records.filter(F.col("review_status") == "pending").withColumn("__all", F.lit(0))
    numbered = positions(waiting.select("__all", "run_id"), ["__all"], [F.col("run_id")], "batch_position")
    dates = numbered.join(slots.select("batch_position", F.col("date").alias("scheduled_date")), "batch_position")
    return keyed_update(records, dates.select("run_id", "scheduled_date"), "run_id", ["scheduled_date"])


def finalize(produced: DataFrame, memory: DataFrame) -> DataFrame:
    """Memory rows of produced items that have none yet: topic, hook, type, structure, style and duration.

    ``produced`` has (content_id, topic, hook, hook_type, story_structure, script_style, duration).
    """
    rows = produced.select(
        F.col("content_id").alias("video_id"), "topic", "hook", "hook_type", "story_structure", "script_style", "duration")
    return insert_if_absent(memory, rows, "video_id", [F.col("topic"), F.col("hook")])


def mark_used(topics: DataFrame, produced: DataFrame) -> DataFrame:
    """Topics that an item was made of are ``used``: those whose angle, or else topic, is the item's."""
    made = produced.select(F.col("topic").alias("__text")).distinct().withColumn("__made", F.lit(True))
    said = text.or_else(F.col("angle"), F.col("topic"))
    return topics.withColumn("__text", said).join(made, "__text", "left").withColumn(
        "status", F.when(F.col("__made"), "used").otherwise(F.col("status"))).select(*topics.columns)
