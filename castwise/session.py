"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs rely on. All are ordinary runtime confs, so they can be
# applied to a session somebody else built.
RUNTIME_CONFS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # whole texts and their lists go through Python: a worker holds a thousand of them, not ten thousand
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def apply_confs(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONFS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, app: str = "castwise", **confs: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        # plans show whole paths, wherever the folders are
        .config("spark.sql.maxMetadataStringLength", "1000")
        # inputs are small here: keep the cores busy instead of merging to one task
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.shuffle.partitions", str(cores) if cores != "*" else "8")
    )
    for key, value in {**RUNTIME_CONFS, **confs}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return apply_confs(spark)


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a session on one machine without that setting (unit tests, a laptop) gets a
    folder of its own; the choice is stored so that later calls use the same one. On
    a cluster a local folder would be a different one on every machine: an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.getCheckpointDir():
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        found = tempfile.mkdtemp(prefix="castwise-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written in here go when it is written, not whenever the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


_STAGED: list[str] = []


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where one intermediate feeds several joins: it is computed a single
    time and survives the loss of the executors that produced it. The folders
    stay until ``clear_staged``, as the frames that read them may be lazy.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/castwise/{label}-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession, keep: int = 0) -> int:
    """Empty the staged folders made since the first ``keep`` of them; call it when a job's results are written.

    Returns how many were emptied. ``len(staged_folders())`` at the start of a job is its ``keep``.
    """
    done = _STAGED[keep:]
    for path in done:
        # the writer removes what was there, on any file system, and leaves an empty table
        spark.range(0).coalesce(1).write.mode("overwrite").parquet(path)
    del _STAGED[keep:]
    return len(done)


def note_staged(path: str) -> None:
    """Let ``clear_staged`` also empty a folder that an operator wrote itself."""
    _STAGED.append(path)


def staged_folders() -> list[str]:
    return list(_STAGED)
