"""Sinks. Every write can be repeated: a lost or re-run job leaves the same table."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castwise.operators.joins import insert_if_absent, keyed_update
from castwise.session import staged


def append_batch(df: DataFrame, path: str, batch_id: str, partitions: Sequence[str] = ()) -> None:
    """Append as batch ``batch_id``, a partition of the table.

    The folder of the batch is replaced as a whole, so writing the same batch again
    leaves one copy of it, whatever partitions its first attempt had.
    """
    if not re.fullmatch(r"[\w.-]+", batch_id):
        raise ValueError("batch_id may hold letters, digits, '_', '-' and '.' only")
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "static")
        .partitionBy(*partitions).parquet(f"{path.rstrip('/')}/batch_id={batch_id}")
    )


def replace_partitions(df: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """Overwrite only the partitions that ``df`` has rows for.

    A partition that loses its last row is not touched; partition by columns an
    update does not change.
    """
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)
    )


def update_rows(
    spark: SparkSession, path: str, changes: DataFrame, key: str, columns: Sequence[str], partitions: Sequence[str]
) -> None:
    """Replace ``columns`` of the stored rows that ``changes`` names; only their partitions are rewritten.

    ``columns`` must not partition the table: a row would be written to its new place and stay in the old one.
    """
    moved = sorted(set(columns) & set(partitions))
    if moved:
        raise ValueError(f"{moved} partition the table and cannot be updated in place")
    stored = spark.read.parquet(path)
    touched = stored.join(changes.select(key), key, "left_semi").select(*partitions).distinct()
    rows = stored.join(touched, list(partitions), "left_semi").select(*stored.columns)
    # read and written are the same folder, so the new rows are finished before the old ones go
    replace_partitions(staged(keyed_update(rows, changes, key, columns), "update"), path, partitions)


def insert_absent(
    existing: DataFrame, new: DataFrame, key: str, path: str, batch_id: str, partitions: Sequence[str] = ()
) -> None:
    """Append the rows whose key is not stored yet.

    ``existing`` must not include ``batch_id`` itself, or a repeated run would find its own rows.
    """
    append_batch(insert_if_absent(existing, new, key), path, batch_id, partitions)


def documents(rows: DataFrame, path: str, key: str, value: str = "value") -> None:
    """One file per row, named in the order of ``key``: for hand-sized exports such as review bundles, not for tables.

    The rows are worked out once, however often their number and ranges are asked for. Files are put in their
    place by the tasks that write them, not one by one by the driver at the end.
    """
    kept = staged(rows.select(key, value), "documents")
    tasks = max(1, -(-kept.count() // 500))  # file numbers within a task keep their order below a thousand
    ordered = kept.repartitionByRange(tasks, key).sortWithinPartitions(key)
    ordered.select(value).write.mode("overwrite").option("maxRecordsPerFile", 1).option(
        "mapreduce.fileoutputcommitter.algorithm.version", 2).text(path)


def json_report(df: DataFrame, path: str, partitions: Sequence[str] = ()) -> None:
    """Nested rows as JSON lines, one folder per partition value."""
    df.write.mode("overwrite").partitionBy(*partitions).json(path)


def single_document(df: DataFrame, path: str) -> None:
    """A one-row result (report, learned rules) as one JSON file."""
    df.limit(1).coalesce(1).write.mode("overwrite").json(path)


def text_table(lines: DataFrame, path: str, order: str, line: str) -> None:
    """All runs' texts as one table (run_id, text), ranges of runs in files of Spark's advisory size.

    A run's lines are put in order and joined inside its row. The number of files follows the bytes, not the runs.
    """
    texts = lines.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("l")))).alias("t"))
    rows = texts.select("run_id", F.array_join(F.transform("t", lambda x: x["l"]), "\n").alias("text"))
    rows.hint("rebalance", "run_id").sortWithinPartitions("run_id").write.mode("overwrite").parquet(path)


def caption_files(cues: DataFrame, path: str, runs: Sequence[object]) -> None:
    """Subtitle text of the given runs: ``run_id=<id>/part-*.txt``, in cue order within and across the parts.

    An export of a few runs, one folder each; ``text_table`` keeps all. Rows are range-partitioned by
    (run_id, cue), so a very long run is written by several tasks and its parts, taken by name, are the file.
    """
    cues = cues.filter(F.col("run_id").isin(*runs))
    ordered = cues.select("run_id", "cue", "cue_text").repartitionByRange("run_id", "cue").sortWithinPartitions("run_id", "cue")
    ordered.select("run_id", "cue_text").write.mode("overwrite").partitionBy("run_id").text(path)


def credit_files(lines: DataFrame, path: str, header: str = "Image credits (openly licensed):") -> None:
    """Attribution text per run: the header, then the lines in order of use."""
    head = lines.select("run_id").distinct().select("run_id", F.lit(-1).alias("position"), F.lit(header).alias("line"))
    rows = head.unionByName(lines.select("run_id", F.col("position").cast("int"), "line"))
    ordered = rows.repartitionByRange("run_id", "position").sortWithinPartitions("run_id", "position", "line")
    ordered.select("run_id", "line").write.mode("overwrite").partitionBy("run_id").text(path)
