"""Lookups, keyed updates and expansion over short literal lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castwise.operators.ranking import top_per_group
from castwise.operators.sequences import positions


def lookup(table: Mapping[str, Any], key: Column, default: Any) -> Column:
    """Value of a configured table, ``default`` for unknown and NULL keys.

    The table is configuration written in the program, so it is part of the
    expression and no join is needed.
    """
    cells = [F.lit(x) for pair in table.items() for x in pair]
    found = F.try_element_at(F.create_map(*cells), key) if cells else F.lit(None)
    return F.coalesce(found, F.lit(default))


def for_each(df: DataFrame, values: Sequence[str], name: str) -> DataFrame:
    """One row per item and list value (the list is configuration, so this only multiplies by its length)."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def cycle(values: Column, index: Column) -> Column:
    """``values[index mod size]``."""
    return F.element_at(values, (F.pmod(index, F.size(values)) + 1).cast("int"))


def first_match(df: DataFrame, lookup_df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Left join to the first matching row by ``order`` (never multiplies ``df``)."""
    return df.join(top_per_group(lookup_df, [key], order, 1), key, "left")


def keyed_update(df: DataFrame, changes: DataFrame, key: str, columns: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """``df`` with the named columns replaced where ``changes`` has a row for the key, by NULL too.

    With ``order`` given, only the first change per key counts; without it keys in
    ``changes`` must be unique.
    """
    if order:
        changes = top_per_group(changes, [key], order, 1)
    renamed = changes.select(key, F.lit(True).alias("__changed"), *[F.col(c).alias(f"__new_{c}") for c in columns])
    joined = df.join(renamed, key, "left")
    new = lambda c: F.when(F.col("__changed"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c)
    out = [new(c) if c in columns else F.col(c) for c in df.columns]
    return joined.select(*out)


def insert_if_absent(existing: DataFrame, new: DataFrame, key: str, order: Sequence[Column] = ()) -> DataFrame:
    """The rows of ``new`` whose key is not in ``existing`` yet (the first of equal keys by ``order``)."""
    if order:
        new = top_per_group(new, [key], order, 1)
    return new.join(existing.select(key), key, "left_anti")


def zip_by_position(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: Sequence[Column], right_order: Sequence[Column]) -> DataFrame:
    """Pair the n-th row of ``left`` with the n-th row of ``right`` inside every group."""
    on = [*keys, "position"]
    return positions(left, keys, left_order).join(positions(right, keys, right_order), on)
