"""Tables as published lists of files: an update rewrites the files it touches, then one rename makes the new list current.

``rows/`` holds Parquet files, one folder per write below it; ``lists/`` holds one small text per version: the schema and
partition columns, then the files. Readers take a list as a whole, so they see a version or the next one, never a
mix, and rows may move between partitions. A job that dies before the rename leaves the old version current; run it again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castwise.operators.joins import keyed_update

WRITE = "__write"  # partition column of the folder a job wrote


class Conflict(RuntimeError):
    """Another writer published first; nothing was changed, run the update again on the new version."""


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the published versions, oldest first."""
    folder, fs = _path(spark, f"{root}/lists")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n.removesuffix(".list")) for n in names if n.endswith(".list"))


def _listed(spark: SparkSession, root: str, version: int) -> tuple[dict, list[str]]:
    lines = spark.read.text(f"{root}/lists/{version:012d}.list", wholetext=True).first()["value"].splitlines()
    return json.loads(lines[0]), lines[1:]


def _publish(spark: SparkSession, root: str, version: int, head: dict, files: Sequence[str]) -> None:
    """Make ``files`` version ``version``; the rename fails if that number is taken."""
    draft, fs = _path(spark, f"{root}/lists/draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write("\n".join([json.dumps(head), *files]).encode())
    out.close()
    final, _ = _path(spark, f"{root}/lists/{version:012d}.list")
    options = spark._sc._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            fs.getUri(), spark._jsc.hadoopConfiguration()).rename(draft, final, options)
    except Exception as error:
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(error):
            raise Conflict(f"version {version} of {root} exists") from error
        raise


def _inside(uri: str) -> str:
    """Place of a file below ``rows/``; '/' and '=' never occur in a folder's value, Spark escapes them."""
    return f"{WRITE}=" + unquote(uri).rsplit(f"/{WRITE}=", 1)[1]


def _relation(spark: SparkSession, root: str, head: dict, files: Sequence[str]) -> DataFrame:
    schema = T.StructType.fromJson(head["schema"])
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{root}/rows").parquet(*[f"{root}/rows/{f}" for f in files])


def _write(df: DataFrame, root: str, partitions: Sequence[str]) -> list[str]:
    """Write rows to a folder of their own, in files of Spark's advisory size per partition; the files' places."""
    folder = f"{root}/rows/{WRITE}=w-{uuid.uuid4().hex}"
    df.hint("rebalance", *partitions).write.partitionBy(*partitions).parquet(folder)
    spark = df.sparkSession
    return sorted(_inside(f) for f in spark.read.schema(df.schema).option("basePath", f"{root}/rows").parquet(folder).inputFiles())


def create(df: DataFrame, root: str, partitions: Sequence[str] = ()) -> None:
    """Publish ``df`` as the first version of a new table.

    As in every table with partition folders, an empty string in a partition column is read back as NULL.
    """
    if WRITE in df.columns:
        raise ValueError(f"{WRITE} is the name of a folder of the table")
    head = {"schema": df.schema.jsonValue(), "partitions": list(partitions)}
    _publish(df.sparkSession, root, 1, head, _write(df, root, partitions))


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The table at a version, by default the newest one at the time of the call; filters on partition columns prune files."""
    if version is None:
        version = versions(spark, root)[-1]
    head, files = _listed(spark, root, version)
    return _relation(spark, root, head, files).select(*[f["name"] for f in head["schema"]["fields"]])


def update(spark: SparkSession, root: str, changes: DataFrame, key: str, columns: Sequence[str], order: Sequence[Column] = ()) -> int:
    """Replace ``columns`` of the stored rows that ``changes`` names (as ``keyed_update``); the version that holds the result.

    Only the key column of the table is read to find the touched files, only these are read whole and rewritten, and
    only file names come to the driver. Partition columns may be among ``columns``. Rows of ``changes``
    without a stored key have no effect; if none has one, no version is made.
    """
    now = versions(spark, root)[-1]
    head, files = _listed(spark, root, now)
    named = _relation(spark, root, head, files)
    if not files:
        return now
    hit = named.select(key, F.col("_metadata.file_path").alias("file_path")).join(changes.select(key), key, "left_semi")
    touched = {_inside(r["file_path"]) for r in hit.select("file_path").distinct().toLocalIterator()}
    if not touched:
        return now
    rows = _relation(spark, root, head, sorted(touched)).select(*[f["name"] for f in head["schema"]["fields"]])
    written = _write(keyed_update(rows, changes, key, columns, order), root, head["partitions"])
    _publish(spark, root, now + 1, head, [f for f in files if f not in touched] + written)
    return now + 1


def forget(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete all but the newest ``keep`` versions and the files that only those listed; how many files went.

    Call it when no reader uses an older version.
    """
    if keep < 1:
        raise ValueError("at least one version is kept")
    known = versions(spark, root)
    old, kept = known[:-keep], known[-keep:]
    used = {f for v in kept for f in _listed(spark, root, v)[1]}
    gone = {f for v in old for f in _listed(spark, root, v)[1]} - used
    for name in [f"rows/{f}" for f in sorted(gone)] + [f"lists/{v:012d}.list" for v in old]:  # files first: a list that is left can be forgotten again
        path, fs = _path(spark, f"{root}/{name}")
        fs.delete(path, False)
    return len(gone)
