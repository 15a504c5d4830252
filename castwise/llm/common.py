"""Table access, staged intermediates and connected components shared by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from castwise.session import note_staged, scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder) -> DataFrame`` under ``name``, with its DuckDB twin if there is one."""

    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


class Stage:
    """Written intermediates of one operator call, all below one folder of the shared scratch space.

    A table that is used more than once is written and read back, so it is computed once and
    outlives executors. ``drop`` frees a table whose successor is written, ``session.clear_staged`` the
    rest once the results are written.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{scratch_dir(spark)}/castwise-llm/{label}-{uuid.uuid4().hex}"
        self.n = 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        note_staged(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._staged_path = path
        return kept

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            # replaced by an empty table: the writer removes the old files on any file system
            self.spark.range(0).write.mode("overwrite").parquet(df._staged_path)


def fold(doc_id: Column, buckets: int) -> Column:
    """crc32 of the id's text modulo ``buckets``; a null id has no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % buckets


def utf8(text: Column) -> Column:
    """The text's bytes; a null text has none."""
    return F.coalesce(text, F.lit("")).cast("binary")


def per_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` of a function that turns one batch into one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def components(edges: DataFrame, stage: Stage) -> DataFrame:
    """``(node, root)`` for every node of the undirected edges ``(a, b)``: root is the smallest node reachable.

    Alternates large-star and small-star steps: first every larger neighbour, then every smaller
    neighbour of a node is tied to the smallest one. Only minima per node are aggregated (map-side
    first) and joined back, so a hub is never gathered. Each round is written, the previous freed.
    """
    big, small = F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    now = stage(edges.filter("a <> b").select(big, small).distinct())
    mark = None
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        tied = large.join(low, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        after = stage(tied.union(low.select("hi", F.col("m").alias("lo"))).distinct())
        stage.drop(now)
        now = after
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    )


def some_of(ids: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows of ``ids``, those with the smallest hashed keys, so the choice repeats.

    A cut by hash leaves not many more than asked for; only these are sorted.
    """
    share = min(1.0, 1.5 * rows / max(1, ids.count()))
    dealt = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    return ids.filter(dealt <= F.lit(int(share * (1 << 30)))).orderBy(dealt, key).limit(rows)


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, lengthened until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def shard_of(doc: np.ndarray, shards: int) -> np.ndarray:
    """The shard of every document: XXH64 of its id modulo the shards, as ``xxhash64`` of a bigint column has it."""
    # fixed values of XXH64
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    h = (np.uint64(42 + 8) + p5) ^ (_rotated(doc.astype(np.int64).view(np.uint64) * p2, 31) * p1)
    h = _rotated(h, 27) * p1 + p4
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    return np.mod((h ^ h >> np.uint64(32)).view(np.int64), shards)
