"""A stored index of a published corpus: new texts are compared with it and added to it, one batch at a time.

Three bucketed tables: ``order`` (how common a shingle was when the index began), ``postings`` (the prefix of every
set in that order) and ``sets`` (the shingles of every text, those first that the most common of the order leave over). The order never
changes, so prefixes of all batches agree; a shingle it does not know counts as rarest. Old texts are never read or cut into shingles
again, and the index is never shuffled: ``probe`` reads its sets past pieces of the batch that all workers hold, ``candidates`` lists pairs by
shuffling a batch to the buckets of the postings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from castwise.operators.sets import (
    closest_of, distinct_texts, kept_column, last_in_order, needed, ordered_sets, shingle_sets, sizes_fit, stored_sets, text_keys)
from castwise.session import clear_staged, shuffles_freed, staged, staged_folders


@dataclass(frozen=True)
class CorpusIndex:
    """Names and shape of an index. ``folder`` holds its files, ``name`` is the prefix of its tables in the session's catalog."""

    spark: SparkSession
    name: str
    folder: str
    threshold: float
    width: int = 3
    buckets: int = 200

    def table(self, part: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{part}")

    def _append(self, rows: DataFrame, part: str, key: str) -> None:
        # one file per bucket and batch: rows are dealt as the buckets are
        with shuffles_freed(self.spark):
            (rows.repartition(self.buckets, key).write.mode("append").option("path", f"{self.folder}/{part}")
             .bucketBy(self.buckets, key).sortBy(key).saveAsTable(f"{self.name}_{part}"))


def create(texts: DataFrame, name: str, folder: str, threshold: float = 0.8, width: int = 3, buckets: int | None = None) -> CorpusIndex:
    """An index whose order of shingles is that of ``texts`` (doc_id, text), which are not yet in it.

    ``buckets`` should be at least ``spark.sql.shuffle.partitions`` (the default), or joins shuffle the index.
    """
    spark = texts.sparkSession
    index = CorpusIndex(spark, name, folder.rstrip("/"), threshold, width, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
    seen = shingle_sets(texts.withColumn("existing", F.lit(True)), width).select(F.explode("sh").alias("s"))
    index._append(seen.groupBy("s").agg(F.count("*").alias("df")).filter(F.col("df") > 1), "order", "s")
    no_sets = spark.createDataFrame([], "node bigint, n int, tokens binary")
    index._append(no_sets, "sets", "node")
    index._append(spark.createDataFrame([], "s bigint, node bigint, n int, i int"), "postings", "s")
    return index


def _sets(batch: DataFrame, index: CorpusIndex) -> DataFrame:
    """``doc_id, node, n, sh`` of a batch. Equal texts are the same node."""
    rows = shingle_sets(batch.select("doc_id", "text", F.lit(False).alias("existing")), index.width)
    return rows.select("doc_id", F.xxhash64("key").alias("node"), "n", "sh")


def prefixes(sets: DataFrame, index: CorpusIndex) -> DataFrame:
    """``s, node, n, i``: the shingles in the prefix of every node, at their place in the order."""
    nodes = sets.filter("n > 0").dropDuplicates(["node"]).select("node", "n", F.explode("sh").alias("s"))
    ranked = nodes.join(index.table("order"), "s", "left").groupBy("node").agg(
        F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "s"))).alias("ranked"))
    kept = F.slice("ranked", F.lit(1), kept_column(F.col("n"), index.threshold).cast("int"))
    return ranked.select("node", "n", F.posexplode(kept).alias("i", "r")).select("r.s", "node", "n", "i")


def candidates(mine: DataFrame, index: CorpusIndex) -> DataFrame:
    """``a, node``: pairs of a new and an old text whose prefixes have enough shingles in common.

    Of the common ones as many as the longer tail has may be missing in the prefixes; pairs are counted, not compared, until then.
    """
    t = index.threshold
    left = mine.select("s", F.col("node").alias("a"), F.col("n").alias("na"))
    met = left.join(index.table("postings"), "s").filter(sizes_fit(F.col("na"), F.col("n"), t)).groupBy("a", "node", "na", "n").agg(F.count("*").alias("met"))
    gone = F.greatest(F.col("na") - kept_column(F.col("na"), t), F.col("n") - kept_column(F.col("n"), t))
    return met.filter(F.col("met") >= needed(F.col("na"), F.col("n"), t) - gone).select("a", "node")


def probe(batch: DataFrame, index: CorpusIndex) -> DataFrame:
    """(doc_id, max_similarity, is_duplicate) of the new texts (doc_id, text) against all published so far.

    Exact from the threshold on, 0 below it; an empty text is like nothing. The texts of a batch are not compared with one another.
    """
    rows = batch.select("doc_id", "text", F.lit(False).alias("existing"))
    ordered = ordered_sets(distinct_texts(rows), index.threshold, index.width, last_in_order(index.table("order")))
    sets = staged(ordered.sortWithinPartitions("n"), "batch-sets")
    best = closest_of(sets, index.table("sets").withColumnRenamed("node", "rep"), index.threshold, within=False)
    sim: Column = F.coalesce("best", F.lit(0.0))
    return text_keys(rows).join(best, "rep", "left").select(
        "doc_id", sim.alias("max_similarity"), (sim >= index.threshold).alias("is_duplicate"))


def publish(batch: DataFrame, index: CorpusIndex) -> int:
    """Add the texts (doc_id, text) to the index; returns how many it did not have. A batch can be published again: nothing doubles.

    Postings are written before sets, and a text counts as published once its set is there.
    """
    keep = len(staged_folders())
    sets = _sets(batch, index).filter("n > 0").dropDuplicates(["node"])
    fresh = staged(sets.join(index.table("sets").select("node"), "node", "left_anti"), "fresh-sets")
    index._append(prefixes(fresh, index), "postings", "s")
    index._append(stored_sets(fresh.withColumnRenamed("node", "rep"), index.threshold, last_in_order(index.table("order"))).withColumnRenamed("rep", "node"), "sets", "node")
    added = fresh.count()
    clear_staged(index.spark, keep)  # the index has them now
    return added
