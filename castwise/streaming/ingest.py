"""Small JSON documents landed once each: a file that was read is never read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castwise.sources.writers import append_batch

BAD = "bad_record"


def land_documents(spark: SparkSession, source: str, target: str, schema: T.StructType, max_files: int = 10_000) -> int:
    """Pack the documents of ``source`` (a folder or pattern, one JSON document a file) that are new since the last call into ``target``.

    Rows are ``path``, the fields of ``schema`` and ``bad_record``: the text of a document that is no such JSON, whose fields
    are null then. The log of read files is the stream's; many small files become few of Spark's advisory size. A
    repeated micro-batch replaces its own rows. Returns how many documents were new.
    """
    fields = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    texts = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", max_files).load(source)
    read = F.from_json("value", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    rows = texts.select(F.col("_metadata.file_path").alias("path"), read.alias("r"))
    good = F.col(f"r.{BAD}").isNull()
    rows = rows.select("path", *[F.when(good, F.col(f"r.{f.name}")).alias(f.name) for f in schema.fields], F.col(f"r.{BAD}").alias(BAD))

    def publish(batch: DataFrame, batch_id: int) -> None:
        append_batch(batch.hint("rebalance"), f"{target}/rows", f"landed-{batch_id}")

    query = rows.writeStream.foreachBatch(publish).option("checkpointLocation", f"{target}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def landed(spark: SparkSession, target: str) -> DataFrame:
    """Everything landed in ``target`` so far."""
    return spark.read.parquet(f"{target}/rows").drop("batch_id")
