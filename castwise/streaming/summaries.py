"""Summaries kept up to date over arriving files. Drained, they equal the batch job."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castwise.session import scratch_dir
from castwise.sources.writers import append_batch

STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FOLD_AFTER = 16  # micro-batches whose changed rows are kept apart


def arriving(spark: SparkSession, path: str, like: DataFrame, max_files: int = 1000) -> DataFrame:
    """A stream over the Parquet files that land under ``path``, a folder or a pattern."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", max_files).parquet(path)


def per_video(analytics: DataFrame) -> DataFrame:
    """Sums per video: tasks add up their own rows first, so a video with a third of them is a few rows."""
    return analytics.groupBy("video_id").agg(
        F.count("*").alias("rows"), F.sum(F.col("views").cast("decimal(28,0)")).alias("views"),
        F.sum(F.col("retention").cast("decimal(18,4)")).cast("decimal(28,4)").alias("retention"), F.count("retention").alias("rated"))


def keyed_stream(sums: DataFrame, folder: str, fold_after: int = FOLD_AFTER) -> None:
    """Keep ``sums``, a streaming aggregation by one key, in the engine's state store and its changed rows in ``folder``.

    A micro-batch writes one row for every key it changed, below ``changed/batch=<id>``; a repeated one writes the same
    again. Every ``fold_after`` batches the last row of each key goes to ``folded`` and the folders before it are emptied.
    """
    spark = sums.sparkSession
    schema = sums.schema

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changed/batch={batch_id}")
        if (batch_id + 1) % fold_after == 0:
            current(spark, folder, schema).write.mode("overwrite").parquet(f"{folder}/folded/upto={batch_id}")
            for old in range(batch_id - fold_after + 1, batch_id + 1):
                spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/changed/batch={old}")
            if batch_id >= fold_after:
                spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/folded/upto={batch_id - fold_after}")

    before = spark.conf.get(STATE_PROVIDER, None)
    spark.conf.set(STATE_PROVIDER, ROCKSDB)  # keys live in the store on disk, not on the executors' heap
    try:
        (sums.writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", f"{folder}/progress")
         .trigger(availableNow=True).start().awaitTermination())
    finally:
        if before is None:
            spark.conf.unset(STATE_PROVIDER)
        else:
            spark.conf.set(STATE_PROVIDER, before)


def current(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The last row of every key of ``keyed_stream``."""
    parts = []
    for kind, number in (("folded", "upto"), ("changed", "batch")):
        try:
            parts.append(spark.read.schema(schema).option("basePath", f"{folder}/{kind}").parquet(f"{folder}/{kind}").select(
                *schema.names, F.col(number).cast("long").alias("number_of_batch")))
        except AnalysisException:  # nothing has arrived, or nothing is folded yet
            continue
    if not parts:
        return spark.createDataFrame([], schema)
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    key, rest = schema.names[0], schema.names[1:]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), "number_of_batch").alias("last"))
    return last.select(key, *[F.col(f"last.{c}").alias(c) for c in rest])


def retention_by_category(analytics: DataFrame, content: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Views and mean retention per category of everything that has arrived: a stream of analytics against the content table.

    Sums per video are a stateful aggregation; the raw rows never meet the content table, which is joined once with one
    row per video. Pass the same ``folder`` again to go on where it stopped.
    """
    spark = analytics.sparkSession
    base = folder or f"{scratch_dir(spark)}/castwise/stream-{label}-{uuid.uuid4().hex}"
    sums = per_video(analytics)
    keyed_stream(sums, base)
    return current(spark, base, sums.schema).join(content.select(F.col("id").alias("video_id"), "category"), "video_id").groupBy("category").agg(
        F.sum("rows").alias("rows"), F.coalesce(F.sum("views"), F.lit(0)).cast("long").alias("total_views"),
        F.round(F.try_divide(F.sum("retention").cast("double"), F.sum("rated").cast("double")), 1).alias("avg_retention"))


def run_counts(runs: DataFrame) -> DataFrame:
    return runs.groupBy("agent", "status").agg(F.count("*").alias("runs"))


def drain(aggregate: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Process everything that has arrived and return the resulting table.

    State and output live in the shared folder. Each trigger writes the whole result
    as a new version, so a repeated trigger overwrites its own version and readers
    never see half of one; only the last two are kept. Pass the same ``folder`` again to go on where it stopped.
    """
    spark = aggregate.sparkSession
    base = folder or f"{scratch_dir(spark)}/castwise/stream-{label}-{uuid.uuid4().hex}"
    schema = aggregate.schema

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/result/version={batch_id}")
        if batch_id > 1:
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{base}/result/version={batch_id - 2}")

    (
        aggregate.writeStream.outputMode("complete").foreachBatch(publish)
        .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    )
    try:
        versions = spark.read.schema(schema).parquet(f"{base}/result")
    except AnalysisException:  # nothing has arrived yet
        return spark.createDataFrame([], schema)
    return versions.filter(F.col("version") == versions.agg(F.max("version")).scalar()).drop("version")


def append_stream(rows: DataFrame, path: str, label: str, folder: str) -> None:
    """Append arriving rows to a table; a replayed micro-batch replaces itself."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        append_batch(batch, path, f"{label}-{batch_id}")

    (
        rows.writeStream.foreachBatch(publish).option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).start().awaitTermination()
    )
