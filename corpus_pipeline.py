"""The training-data pipeline: stages over ``documents``, each written as Parquet and read by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castwise.llm import mixing, packing, quality, simhash, suffix
from castwise.llm.common import read
from castwise.session import clear_staged, note_staged, scratch_dir, staged_folders


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies."""
    return simhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes and more that an earlier document has are cut out; documents left empty go."""
    return suffix.deduplicated(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target shares of clean, low and toxic text ask for."""
    return mixing.mixed(docs, mixing.labelled_domains(read(spark, sf_dir, "labels")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in training sequences."""
    return packing.pack_documents(docs, packing.default_tokenizer())


STAGES = [
    ("quality classifier", quality_filter),
    ("simhash near-dedup", near_dedup),
    ("suffix-array dedup", substring_dedup),
    ("mixing", mix),
    ("packing", pack),
]
ORACLE_SQL = None  # hashes, trees and suffix intervals are beyond SQL; the tests use brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; every stage is written once and survives lost executors.

    What a stage staged, and its predecessor's rows, are emptied when its own rows are written; ``clear_staged`` frees the last.
    """
    docs = read(spark, sf_dir, "documents")
    root = f"{scratch_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    keep = len(staged_folders())
    for n, (_, stage) in enumerate(STAGES):
        path = f"{root}/{n}"
        stage(spark, docs, sf_dir).write.parquet(path)
        clear_staged(spark, keep)
        note_staged(path)
        docs = spark.read.parquet(path)
    return docs
