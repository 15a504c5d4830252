"""Hooks and titles: score every candidate, pick one per item."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castwise import params as P
from castwise.functions import scores, text
from castwise.operators.ranking import flag_best, top_per_group
from castwise.session import staged


def hook_lines(replies: DataFrame, item: str, position: str, body: str, min_length: int = 15) -> DataFrame:
    """One cleaned line per row out of multi-line replies; short lines go. ``line`` counts within the reply."""
    return (
        replies.select(item, position, F.posexplode_outer(F.split(body, r"\r\n|\r|\n")).alias("line", "raw"))
        .withColumn("hook", text.clean_hook(F.col("raw")))
        .filter(F.length("hook") > min_length)
        .drop("raw")
    )


def pad_hooks(candidates: DataFrame, items: DataFrame, item: str, position: str, minimum: int = 10,
              filler: str = P.HOOK_FILLER) -> DataFrame:
    """Every item of (item, topic) gets filler lines up to ``minimum`` hooks, placed behind its own."""
    sizes = candidates.groupBy(item).agg(F.count("*").alias("__n"), F.max(position).alias("__last"))
    missing = items.join(sizes, item, "left").withColumn("__n", F.coalesce("__n", F.lit(0))).filter(F.col("__n") < minimum)
    lines = missing.select(
        item, "topic", F.coalesce(F.col("__last").cast("long"), F.lit(-1)).alias("__last"),
        F.explode(F.sequence(F.lit(1), minimum - F.col("__n"))).alias("__i"),
    ).select(
        item, (F.col("__last") + F.col("__i")).alias(position),
        text.fill_template(filler, {"topic": F.col("topic")}).alias("hook"),
    )
    return candidates.select(item, F.col(position).cast("long").alias(position), "hook").unionByName(lines)


def rank_hooks(
    candidates: DataFrame,
    item: str,
    position: str,
    signals: Mapping[str, Iterable[str]] = P.HOOK_SIGNALS,
    bases: Mapping[str, int] = P.HOOK_BASES,
) -> DataFrame:
    """Score every hook; ``selected`` marks the best per item, the earlier of equals."""
    dims = scores.hook_dimensions(F.col("hook"), signals, bases)
    with_dims = candidates.select(item, position, "hook", *[c.cast("double").alias(n) for n, c in dims.items()])
    named = {n: F.col(n) for n in dims}
    # scored once: the winners are found in narrow stored rows and joined back on the key
    rated = with_dims.withColumn("total", scores.hook_total(named)).withColumn("hook_type", scores.hook_type(named))
    return flag_best(staged(rated, "hooks"), [item], position, [F.col("total").desc(), F.col(position)])


def best_titles(
    candidates: DataFrame,
    item: str,
    position: str,
    title: str,
    markers: Iterable[str] = P.TITLE_MARKERS,
    min_length: int = 8,
    fallback: DataFrame | None = None,
) -> DataFrame:
    """The best title per item. Lines of ``min_length`` characters or fewer and blank titles are no candidates.

    ``fallback`` has (item, title): an item without any candidate takes this one, so every item has a title.
    """
    cleaned = (
        candidates.filter(F.length(text.strip(F.col(title))) > min_length)
        .select(item, position, text.clean_title(F.col(title)).alias("title"))
        .filter(F.col("title") != "")
        .withColumn("score", scores.title_score(F.col("title"), markers))
    )
    best = top_per_group(cleaned, [item], [F.round("score", 4).desc(), F.col(position)], 1).withColumn("score", F.round("score", 1))
    if fallback is None:
        return best
    spare = fallback.select(item, F.col("title").alias("__spare"))
    chosen = spare.join(best, item, "left")
    score = F.coalesce("score", F.round(scores.title_score(F.col("__spare"), markers), 1))
    return chosen.select(item, position, F.coalesce("title", "__spare").alias("title"), score.alias("score"))


def thumbnail_variants(items: DataFrame, styles=P.THUMBNAIL_STYLES, variants: int = 3, max_words: int = 6) -> DataFrame:
    """Variant rows per item: headline text, style by position, the first one selected."""
    cells = F.array(*[F.struct(F.lit(n).alias("design_style"), F.lit(t).alias("text_style")) for n, t in styles[:variants]])
    return items.select(
        "id", text.headline(F.col("title"), max_words).alias("headline"), F.posexplode(cells).alias("variant", "style")
    ).select(
        "id", "headline", F.concat(F.lit("v"), F.col("variant").cast("string")).alias("version"),
        "style.design_style", "style.text_style", (F.col("variant") == 0).alias("selected"),
    )
