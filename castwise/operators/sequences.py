"""Running totals over long groups, slot allocation and interleaving."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from castwise.session import staged


def running_totals(df: DataFrame, keys: Sequence[str], index: str, measures: Mapping[str, Column], block: int = 65_536) -> DataFrame:
    """Inclusive running sums by ``index`` inside every group.

    ``index`` is a whole number counting up from 0. A group is cut into blocks of
    ``block`` consecutive indexes: sums inside a block need only that block, and the
    sums of the blocks before it come from one row per block. So a single huge
    group is spread over many tasks and never sorted as one.
    """
    cut = df.withColumn("__block", F.floor(F.col(index) / block))
    for name, measure in measures.items():
        cut = cut.withColumn(f"__m_{name}", measure)
    part = [*keys, "__block"]
    inside = Window.partitionBy(*part).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)

    per_block = cut.groupBy(*part).agg(*[F.sum(f"__m_{n}").alias(f"__s_{n}") for n in measures])
    offsets = per_block.select(*part, *[F.sum(f"__s_{n}").over(before).alias(f"__o_{n}") for n in measures])
    # block 0 never has anything before it, so most groups bring no offset row at all
    offsets = offsets.filter(F.col("__block") > 0)

    local = cut
    for name in measures:
        local = local.withColumn(f"__l_{name}", F.sum(f"__m_{name}").over(inside))
    joined = local.join(offsets, part, "left")
    return joined.select(
        *df.columns,
        *[(F.col(f"__l_{n}") + F.coalesce(F.col(f"__o_{n}"), F.lit(0))).alias(n) for n in measures],
    )


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "position") -> DataFrame:
    """Number the rows of every group from 1 in ``order`` (which must be total).

    Rows are range-partitioned by group and order, numbered inside each piece, and
    shifted by the sizes of the group's earlier pieces. One group may therefore span
    any number of tasks. The pieces are written out, so a retry cannot cut differently.
    """
    ranged = df.repartitionByRange(*keys, *order).withColumn("__piece", F.spark_partition_id())
    pieces = staged(ranged, "positions")
    part = [*keys, "__piece"]
    before = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    shifts = pieces.groupBy(*part).agg(F.count("*").alias("__n")).select(
        *part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift")
    )
    local = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
    return pieces.withColumn("__local", local).join(shifts, part).select(
        *df.columns, (F.col("__local") + F.col("__shift")).alias(name)
    )


def largest_remainder(shares: Sequence[float], n: Column) -> Column:
    """Array of whole counts summing to ``n``: floors first, leftovers to the largest fractions.

    Equal fractions prefer the larger share, then the earlier entry.
    """
    exact = [F.lit(float(s)) * n for s in shares]
    floors = [F.floor(x).cast("int") for x in exact]
    left = n.cast("int") - sum(floors)
    order = F.array_sort(
        F.array(*[F.struct((f - x).alias("f"), F.lit(-float(s)).alias("s"), F.lit(i).alias("i"))
                  for i, (x, f, s) in enumerate(zip(exact, floors, shares))])
    )
    ranks = F.transform(order, lambda o: o["i"])
    return F.array(*[f + (F.array_position(ranks, i) <= left).cast("int") for i, f in enumerate(floors)])


def interleave(counts: Column, k: int) -> Column:
    """Spread ``k`` entries over ``sum(counts)`` slots: array of entry numbers, one per slot.

    Each slot takes the entry with most picks left; among equals the one that comes
    first when the list is read from ``slot mod k``.
    """
    total = F.aggregate(counts, F.lit(0), lambda acc, x: acc + x)
    slots = F.when(total > 0, F.sequence(F.lit(0), total - 1)).otherwise(F.array().cast("array<int>"))
    start = F.struct(counts.cast("array<int>").alias("left"), F.array().cast("array<int>").alias("picks"))

    def step(acc: Column, slot: Column) -> Column:
        left = acc["left"]
        most = F.array_max(left)
        reading = F.array(*[F.pmod(slot + j, F.lit(k)) for j in range(k)])
        pick = F.element_at(F.filter(reading, lambda j: F.get(left, j) == most), 1)
        return F.struct(
            F.transform(left, lambda v, i: v - (i == pick).cast("int")).alias("left"),
            F.concat(acc["picks"], F.array(pick)).alias("picks"),
        )

    return F.aggregate(slots, start, step, lambda acc: acc["picks"])
