"""Time labels and caption timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")


def week_label(ts: Column) -> Column:
    """``YYYY-Www`` with weeks starting on Monday; the days before the first Monday are week 00."""
    week = F.floor((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7)
    return F.concat(F.year(ts).cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def srt_time(seconds: Column) -> Column:
    """``HH:MM:SS,mmm`` of decimal seconds, milliseconds cut off, never negative."""
    ms = F.floor(F.greatest(seconds, F.lit(0)).cast("decimal(20,3)") * 1000).cast("long")
    return F.format_string(
        "%02d:%02d:%02d,%03d",
        F.floor(ms / 3_600_000).cast("long"),
        F.pmod(F.floor(ms / 60_000).cast("long"), F.lit(60)),
        F.pmod(F.floor(ms / 1000).cast("long"), F.lit(60)),
        F.pmod(ms, F.lit(1000)),
    )


def date_spine(start: Column, days: Column | int) -> Column:
    n = F.lit(days) if isinstance(days, int) else days
    return F.sequence(start, F.date_add(start, n - 1))


def on_days(day: Column, names: tuple[str, ...]) -> Column:
    return F.weekday(day).isin([WEEKDAYS.index(n) for n in names if n in WEEKDAYS])
