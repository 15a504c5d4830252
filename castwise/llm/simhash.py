"""SimHash near-duplicates: pigeonhole blocks, Hamming verification, connected components."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from castwise.llm.common import components, free_name, per_batch, query, read, Stage, utf8

BITS = 64


def fingerprint(data: bytes, shingle: int = 3, seed: int = 42, chunk: int = 1 << 18) -> int:
    """64-bit SimHash of the ASCII-lowered words, as a signed number.

    A bit is set if it is set in over half of the shingle hashes. Texts with fewer words than a
    shingle hash their whole word sequence; texts without words have fingerprint zero.
    """
    words = data.lower().split()
    if not words:
        return 0
    hash_of = xxhash.xxh64_intdigest
    last = max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, np.int64)
    for start in range(0, last, chunk):
        stop = min(last, start + chunk)
        runs = [words[start + i: stop + i] for i in range(min(shingle, len(words)))]
        hashes = np.array([hash_of(b" ".join(s), seed) for s in zip(*runs)], np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > last, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` without its text, with the fingerprint (bigint) of every row."""
    others = [c for c in docs.columns if c != text]
    mine = free_name(docs, "text_of_row")
    bare = docs.select(*others, utf8(F.col(text)).alias(mine))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = pa.array([fingerprint(x) for x in batch.column(mine).to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], values], [*others, name])

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    return per_batch(bare, run, f"{kept}{', ' if others else ''}`{name}` bigint")


def _keys(value: Column, blocks: int, shared: int) -> Column:
    """One key for every choice of ``shared`` of the ``blocks`` equal pieces of a fingerprint."""
    width = BITS // blocks
    piece = [F.shiftrightunsigned(value, width * i).bitwiseAND(F.lit((1 << width) - 1)) for i in range(blocks)]
    keys = []
    for n, chosen in enumerate(itertools.combinations(range(blocks), shared)):
        bits = F.lit(0).cast("bigint")
        for i in chosen:
            bits = F.shiftleft(bits, width).bitwiseOR(piece[i])
        keys.append(F.struct(F.lit(n).alias("choice"), bits.alias("bits")))
    return F.array(*keys)


def links(prints: DataFrame, distance: int, stage: Stage, blocks: int = 4, dense: int = 64) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly the fingerprints (column ``f``, distinct) reachable by links.

    Two prints within ``distance`` bits agree on at least ``blocks - distance`` of the blocks, so
    they meet under a key made of these; pairs that meet are verified. A key held by more than
    ``dense`` prints would make a square of pairs: its prints are tied to the 65 points at most one
    bit away from them instead, and prints that share a point are linked to the smallest of them
    (at most two bits away by the triangle inequality, and every pair two bits apart shares one).
    That costs a fixed number of rows per print and loses nothing.
    """
    if distance != 2:
        raise ValueError("the balls are built for distance 2")
    keyed = stage(prints.select("f", F.explode(_keys(F.col("f"), blocks, blocks - distance)).alias("k")).select("f", "k.*"))
    key = ["choice", "bits"]
    crowded = keyed.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > dense).select(*key)
    sparse = keyed.join(crowded, key, "left_anti")
    other = sparse.select(*key, F.col("f").alias("g"))
    near = F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= distance
    pairs = sparse.join(other, key).filter((F.col("f") < F.col("g")) & near).select(F.col("f").alias("a"), F.col("g").alias("b"))

    points = [F.col("f")] + [F.col("f").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint")) for i in range(BITS)]
    balls = keyed.join(crowded, key, "left_semi").select("f").distinct().select("f", F.explode(F.array(*points)).alias("point"))
    centre = balls.groupBy("point").agg(F.min("f").alias("a"), F.max("f").alias("z")).filter("a < z").select("point", "a")
    tied = balls.join(centre, "point").filter("f > a").select("a", F.col("f").alias("b"))
    return pairs.union(tied).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = 2) -> DataFrame:
    """Every row's ``key``, fingerprint (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest key reachable over links of at most ``distance`` differing
    bits. Null and empty texts have fingerprint zero and link like any other. Repeated rows are
    kept and share their values; a row with a null key belongs to its component but never names
    it (a component of null keys only has a null id). Other columns of ``docs`` are ignored.
    """
    stage = Stage(docs.sparkSession, "simhash")
    marked = stage(fingerprints(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), name="f"))
    classes = stage(marked.groupBy("f").agg(F.min("key").alias("first")))
    roots = stage(components(links(classes.select("f"), distance, stage), stage))
    # the smallest key of a component: few rows, aggregated before they meet the documents
    tied = classes.join(roots, classes["f"] == roots["node"], "left").select(
        "f", "first", F.coalesce("root", "f").alias("root"))
    least = tied.groupBy("root").agg(F.min("first").alias("component_id"))
    named = tied.join(least, "root").select("f", "component_id")
    out = marked.join(named, "f")
    return out.select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = 2) -> DataFrame:
    """``docs`` with one document of each near-duplicate component: the one with the smallest key.

    Of rows that repeat that key one stays. Rows with a null key cannot be told apart and all stay.
    """
    stage = Stage(docs.sparkSession, "simhash-keep")
    found = near_duplicates(docs, key, text, distance)
    named = stage(found.filter(F.col(key) == F.col("component_id")).select(key).distinct())
    return docs.join(named, key, "left_semi").dropDuplicates([key]).unionByName(docs.filter(F.col(key).isNull()))


@query("op1_simhash")
def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components of all documents: SimHash over 3-word shingles, at most 2 bits apart."""
    return near_duplicates(read(spark, folder, "documents"))
