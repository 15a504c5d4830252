"""Sums kept per batch, so that a batch can be replaced: its old part goes out with it.

A batch of analytics leaves one row per video, below its own folder. Totals add up these rows; the analytics
themselves are read once, when their batch comes. Storing a batch again under its id replaces its part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castwise.sources.writers import append_batch


def parts(analytics: DataFrame) -> DataFrame:
    """One mergeable row per video: a third of the rows under one video is a few rows per task before the shuffle."""
    return analytics.groupBy("video_id").agg(
        F.count("*").alias("rows"), F.sum(F.col("views").cast("decimal(18,0)")).cast("decimal(28,0)").alias("views"),
        F.sum(F.col("retention").cast("decimal(18,4)")).cast("decimal(28,4)").alias("retention"), F.count("retention").alias("rated"))


def store_batch(analytics: DataFrame, path: str, batch_id: str) -> None:
    """Keep the part of this batch; an earlier part under the same id is taken out."""
    append_batch(parts(analytics), path, batch_id)


def totals(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame:
    """Per video what all batches add up to. With ``keys`` (video_id) only of those."""
    kept = spark.read.parquet(path)
    if keys is not None:
        kept = kept.join(keys.select("video_id"), "video_id", "left_semi")
    return kept.groupBy("video_id").agg(
        F.sum("rows").cast("bigint").alias("rows"), F.sum("views").cast("bigint").alias("views"),
        F.sum("retention").alias("retention"), F.sum("rated").cast("bigint").alias("rated"))


def by_category(sums: DataFrame, content: DataFrame) -> DataFrame:
    """Rows, views and mean retention per category from sums per video."""
    return sums.join(content.select(F.col("id").alias("video_id"), "category"), "video_id").groupBy("category").agg(
        F.sum("rows").cast("bigint").alias("rows"), F.coalesce(F.sum("views"), F.lit(0)).cast("bigint").alias("views"),
        F.round(F.try_divide(F.sum("retention").cast("double"), F.sum("rated").cast("double")), 1).alias("avg_retention"))
