"""Table and JSON-folder scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castwise import schemas


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder. Filters and column choices on it reach the scan."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def json_documents(spark: SparkSession, glob: str, schema: T.StructType | str) -> DataFrame:
    """One row per JSON file, with its ``path``."""
    rows = spark.read.schema(schema).option("multiLine", True).json(glob)
    return rows.select("*", F.col("_metadata.file_path").alias("path"))


def review_bundles(spark: SparkSession, root: str) -> DataFrame:
    """Every ``<run>/review.json`` below ``root``, in path order when displayed by ``orderBy('path')``."""
    return json_documents(spark, f"{root.rstrip('/')}/*/review.json", schemas.REVIEW_RECORD)


def checkpoints(spark: SparkSession, root: str) -> DataFrame:
    """Every ``<run>.json`` below ``root``; join on run_id, a missing file is a missing row."""
    return json_documents(spark, f"{root.rstrip('/')}/*.json", schemas.CHECKPOINT)
