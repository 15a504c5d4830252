"""Platform metadata, publish packages and results, image credits."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castwise import params as P
from castwise.functions import text
from castwise.operators.joins import for_each, lookup
from castwise.operators.ranking import first_occurrence, top_per_group


def default_description(topic: Column, brand: str, cta: str) -> Column:
    return F.concat(F.lit(f"A {brand} documentary about "), topic, F.lit(f". {cta}"))


def _rule(rules: Mapping[str, P.Platform], field: str, platform: Column) -> Column:
    return lookup({p: getattr(r, field) for p, r in rules.items()}, platform, getattr(P.Platform(), field))


def platform_metadata(
    items: DataFrame,
    platforms: Sequence[str] = tuple(P.PLATFORMS),
    rules: Mapping[str, P.Platform] = P.PLATFORMS,
    base_tags: Sequence[str] = P.BASE_HASHTAGS,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per item and platform, every text trimmed to the platform's limits.

    ``items`` has (id, topic, category, title, description, disclosure); columns named in
    ``carry`` (such as video_path, thumbnail_path, srt_path) come along. Row-local: no shuffle.
    """
    base = F.array(F.col("category"), *[F.lit(w) for w in P.KEYWORD_BASE])
    told = F.when(
        text.present(F.col("disclosure")), F.concat("description", F.lit("\n\n"), "disclosure")
    ).otherwise(F.col("description"))
    prepared = items.select(
        "id", "category", "title", told.alias("told"), text.keywords(F.col("topic"), base).alias("words"), *carry,
    )
    rows = for_each(prepared, platforms, "platform")
    p = F.col("platform")
    hint = _rule(rules, "optimize_for", p)
    desc = F.concat(
        text.strip(F.concat(_rule(rules, "opener", p), F.col("told"))),
        F.when(hint != "", F.concat(F.lit("\n\n[optimized for: "), hint, F.lit("]"))).otherwise(F.lit("")),
    )
    tags = F.array(
        *[F.lit(t) for t in base_tags], F.concat(F.lit("#"), "category", F.lit("facts")),
        *[F.lit(t) for t in P.CATEGORY_HASHTAGS],
    )
    return rows.select(
        "id", "platform", "category",
        text.fit(F.col("title"), _rule(rules, "title_max", p)).alias("title"),
        text.fit(desc, _rule(rules, "desc_max", p)).alias("description"),
        F.slice("words", F.lit(1), _rule(rules, "tags", p)).alias("tags"),
        F.slice(tags, F.lit(1), _rule(rules, "hashtags", p)).alias("hashtags"),
        *carry,
    )


def publish_results(
    packages: DataFrame,
    dry_run: bool = True,
    configured: Iterable[str] = (),
    credentials: Mapping[str, Sequence[str]] = P.PLATFORM_CREDENTIALS,
) -> DataFrame:
    """What would happen to every package: skipped, dry_run or eligible. Nothing is sent anywhere."""
    known = F.col("platform").isin(list(credentials))
    ready = F.col("platform").isin(list(configured)) if configured else F.lit(False)
    missing = lookup({p: ", ".join(keys) for p, keys in credentials.items()}, F.col("platform"), "")
    if dry_run:
        status, note = F.lit("dry_run"), F.concat(F.lit("Would publish '"), "title", F.lit("' (dry_run enabled)."))
    else:
        status = F.when(ready, "eligible").otherwise("dry_run")
        note = F.when(ready, F.lit("")).otherwise(F.concat(F.lit("missing credentials: "), missing))
    return packages.withColumn("status", F.when(known, status).otherwise("skipped")).withColumn(
        "note", F.when(known, note).otherwise("no publisher plugin")
    )


def publish_manifest(results: DataFrame, run: str = "id", generated_at: Column | None = None, dry_run: bool = True) -> DataFrame:
    """One nested row per run: its packages and results (as many as there are platforms), any of them published,
    when it was made (default: now) and whether nothing was to be sent."""
    paths = [c for c in ("video_path", "thumbnail_path", "srt_path") if c in results.columns]
    package = F.struct(
        "platform", "title", "description", "tags", "hashtags", "category", *paths, F.lit("private").alias("privacy"))
    return results.groupBy(run).agg(
        F.array_sort(F.collect_list(package)).alias("packages"),
        F.array_sort(F.collect_list(F.struct("platform", "status", "note"))).alias("results"),
        F.bool_or(F.col("status").isin("published", "dry_run")).alias("published"),
    ).withColumn("generated_at", F.current_timestamp() if generated_at is None else generated_at).withColumn("dry_run", F.lit(dry_run))


def image_pool(hits: DataFrame, count: int) -> DataFrame:
    """The first ``count`` distinct images per topic, by query and provider priority, then position."""
    order = [F.col("query_rank"), F.col("provider_rank"), F.col("position"), F.col("title")]
    distinct = first_occurrence(hits, F.col("url"), order, within=["topic_id"])
    return top_per_group(distinct, ["topic_id"], [*order, F.col("url")], count, rank="pool_index")


def credit_lines(credits: DataFrame) -> DataFrame:
    """One attribution line per distinct (title, source) of a run, in order of use."""
    firsts = top_per_group(
        credits, ["run_id", "title", "source"], [F.col("position"), F.col("credit"), F.col("license")], 1
    )
    who = F.when(text.present(F.col("credit")), F.concat(F.lit(" by "), "credit")).otherwise(F.lit(""))
    return firsts.select("run_id", "position", F.concat(
        F.lit("- "), F.coalesce("title", F.lit("")), who, F.lit(" — "), F.coalesce("source", F.lit("")),
        F.lit(" ("), F.coalesce("license", F.lit("")), F.lit(")"),
    ).alias("line"))
