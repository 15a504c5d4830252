"""Publishing calendars, one per channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from castwise import params as P
from castwise.functions import clock
from castwise.operators.ranking import top_per_group
from castwise.operators.sequences import interleave, largest_remainder


def calendar(channels: DataFrame, rules: P.CalendarRules = P.CalendarRules()) -> DataFrame:
    """Slots of every channel (channel_id, start): date, format, category and sub-category.

    The order of categories and sub-categories depends on the number of slots only, so
    it is worked out once per number that occurs (a handful: which weekdays the period
    starts and ends with). The rest happens inside the channel's row.
    """
    names = list(rules.mix)
    for name in names:
        if len(rules.subcategories.get(name, (name,))) <= rules.repeat_window:
            raise ValueError(f"category {name!r} needs more than {rules.repeat_window} sub-categories")

    day = lambda d: F.when(clock.on_days(d, rules.long_days), "long").when(clock.on_days(d, rules.short_days), "short")
    slots = F.filter(
        F.transform(clock.date_spine(F.col("start"), rules.days), lambda d: F.struct(d.alias("d"), day(d).alias("f"))),
        lambda s: s["f"].isNotNull(),
    )
    with_slots = channels.select("channel_id", slots.alias("slots")).withColumn("n", F.size("slots"))
    rows = with_slots.join(_pattern(with_slots.select("n").distinct(), rules, names), "n").select(
        "channel_id",
        # the outer form keeps the optimizer from testing the arrays in front, which would build them twice
        F.posexplode_outer(F.zip_with("slots", "pattern", lambda s, p: F.struct(
            s["d"].alias("d"), s["f"].alias("f"), p["category"].alias("c"), p["subcategory"].alias("sub"),
        ))).alias("slot", "s"),
    ).filter(F.col("slot").isNotNull())
    return rows.select(
        "channel_id", "slot",
        F.col("s.d").cast("string").alias("date"),
        F.date_format("s.d", "E").alias("weekday"),
        F.col("s.c").alias("category"), F.col("s.sub").alias("subcategory"), F.col("s.f").alias("format"),
    )


def _pattern(numbers: DataFrame, rules: P.CalendarRules, names: list[str]) -> DataFrame:
    """For every number of slots ``n`` in ``numbers``: category and sub-category of each slot."""
    n = F.col("n")
    counts = largest_remainder(list(rules.mix.values()), n)
    subs = F.array(*[F.array(*[F.lit(s) for s in rules.subcategories.get(c, (c,))]) for c in names])
    labels = F.array(*[F.lit(c) for c in names])

    def slot(c: Column, i: Column) -> Column:
        # how often the category came before: its place in the rotation
        turn = F.size(F.filter(F.slice("picks", F.lit(1), i), lambda x: x == c))
        options = F.get(subs, c)
        return F.struct(
            F.element_at(labels, c + 1).alias("category"),
            F.element_at(options, F.pmod(turn, F.size(options)) + 1).alias("subcategory"),
        )

    return (
        numbers.select("n", interleave(counts, len(names)).alias("picks"))
        .select("n", F.transform("picks", slot).alias("pattern"))
    )


def plan_batch(slots: DataFrame, count: int, category: str | None = None, video_format: str | None = None) -> DataFrame:
    """The next ``count`` slots per channel, optionally of one category ("both" is any) and one format."""
    if category and category != "both":
        slots = slots.filter(F.col("category") == category)
    if video_format:
        slots = slots.filter(F.col("format") == video_format)
    return top_per_group(slots, ["channel_id"], [F.col("slot")], count, rank="batch_position")


def adjacent_repeats(slots: DataFrame, counted: str = P.DEFAULT_CATEGORY) -> DataFrame:
    """Quality check per channel: slots, those of the ``counted`` category, and neighbours with equal category and sub-category."""
    w = Window.partitionBy("channel_id").orderBy("slot")  # a channel has at most ``days`` slots
    same = (F.lag("category").over(w) == F.col("category")) & (F.lag("subcategory").over(w) == F.col("subcategory"))
    return slots.withColumn("__same", F.coalesce(same, F.lit(False))).groupBy("channel_id").agg(
        F.count("*").alias("slots"),
        F.count_if(F.col("category") == F.lit(counted)).alias(f"{counted}_slots"),
        F.count_if(F.col("__same")).alias("adjacent_repeats"),
    )
