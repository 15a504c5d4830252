"""Top-k, best-per-group, first occurrence and fill-up.

All per-group selections are written as ``row_number() <= k``. Spark then puts a
group limit in front of the shuffle, so each task forwards at most k rows per
group and a group holding a third of the table costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_RANK = "__rank"


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of every group; ``order`` must be total for a repeatable answer."""
    ranked = df.withColumn(_RANK, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(_RANK) <= k)
    return kept.withColumnRenamed(_RANK, rank) if rank else kept.drop(_RANK)


def top(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def first_occurrence(df: DataFrame, key: Column, order: Sequence[Column], within: Sequence[str] = ()) -> DataFrame:
    """One row per distinct ``key`` (inside ``within``), the earliest by ``order``; blank keys go."""
    keyed = df.withColumn("__key", key).filter(F.col("__key").isNotNull() & (F.col("__key") != ""))
    return top_per_group(keyed, [*within, "__key"], order, 1).drop("__key")


def flag_best(df: DataFrame, item: Sequence[str], position: str, order: Sequence[Column], flag: str = "selected") -> DataFrame:
    """Every row, with exactly one flagged per item.

    The winners are found first and joined back on (item, position), a key without
    hot values even where one item holds most rows. (item, position) must be unique.
    ``df`` is read twice: store it first if it is costly.
    """
    on = [*item, position]
    winners = top_per_group(df, item, order, 1).select(*on, F.lit(True).alias(flag))
    return df.join(winners, on, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def fill_if_short(primary: DataFrame, fallback: DataFrame, keys: Sequence[str], minimum: int) -> DataFrame:
    """Primary rows, plus fallback rows for the groups with fewer than ``minimum`` of them.

    ``source_rank`` 0 marks primary and 1 fallback rows.
    """
    sizes = primary.groupBy(*keys).agg(F.count("*").alias("__n"))
    needed = (
        fallback.join(sizes, list(keys), "left")
        .filter(F.coalesce(F.col("__n"), F.lit(0)) < minimum)
        .drop("__n")
    )
    return primary.withColumn("source_rank", F.lit(0)).unionByName(needed.withColumn("source_rank", F.lit(1)))
