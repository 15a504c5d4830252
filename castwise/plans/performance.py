"""Performance roll-ups, the learning loop and the strategy report."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from castwise import params as P
from castwise.functions import scores, text
from castwise.functions.clock import week_label
from castwise.operators.joins import keyed_update
from castwise.operators.ranking import top, top_per_group

EXACT = "decimal(38,4)"


def _mean(total: Column, n: Column) -> Column:
    """Mean of exactly summed values, as a double; NULL for no rows."""
    return F.when(n > 0, total.cast("double") / n)


def per_video(analytics: DataFrame) -> DataFrame:
    """One row per video. Shrinks the big side before any join, and a hot video to one row."""
    return analytics.groupBy("video_id").agg(
        F.coalesce(F.sum("views"), F.lit(0)).alias("views"),
        F.sum(F.col("retention").cast("decimal(18,4)")).alias("retention_sum"),
        F.count("retention").alias("retention_n"),
    )


def analytics_summary(content: DataFrame, analytics: DataFrame) -> DataFrame:
    """Published videos, items, all views, mean retention: one row, one pass over each table."""
    none = F.lit(None)
    items = content.select(
        (F.col("status") == "published").cast("long").alias("published"),
        F.lit(1).cast("long").alias("items"),
        none.cast("long").alias("views"),
        none.cast("decimal(18,4)").alias("retention"),
    )
    facts = analytics.select(
        none.cast("long").alias("published"),
        none.cast("long").alias("items"),
        F.col("views").cast("long").alias("views"),
        F.col("retention").cast("decimal(18,4)").alias("retention"),
    )
    return items.unionByName(facts).agg(
        F.coalesce(F.sum("published"), F.lit(0)).alias("published"),
        F.coalesce(F.sum("items"), F.lit(0)).alias("items"),
        F.coalesce(F.sum("views"), F.lit(0)).alias("total_views"),
        F.round(F.coalesce(_mean(F.sum("retention"), F.count("retention")), F.lit(0.0)), 1).alias("avg_retention"),
    )


def stored_performance(content: DataFrame, analytics: DataFrame, memory: DataFrame) -> DataFrame:
    """Every remembered content with its summed analytics. On tables in buckets of the video nothing is shuffled."""
    sums = per_video(analytics).select(
        F.col("video_id").alias("id"), "views", F.round(_mean(F.col("retention_sum"), F.col("retention_n")), 1).alias("retention"))
    known = memory.select(F.col("video_id").alias("id"), "hook_type", "performance_score")
    return content.select("id", "category", "status").join(sums, "id", "left").join(known, "id")


def retention_by_category(content: DataFrame, analytics: DataFrame) -> DataFrame:
    """Mean retention per category over every status; categories without analytics do not appear."""
    return (
        content.select(F.col("id").alias("video_id"), "category")
        .join(per_video(analytics), "video_id")
        .groupBy("category")
        .agg(F.round(_mean(F.sum("retention_sum"), F.sum("retention_n")), 1).alias("avg_retention"))
    )


def retention_nonzero(analytics: DataFrame) -> DataFrame:
    """Mean over the rows that have a retention other than zero; 0.0 if there are none."""
    r = F.when(F.col("retention") != 0, F.col("retention").cast("decimal(18,4)"))
    return analytics.agg(
        F.round(F.coalesce(_mean(F.sum(r), F.count(r)), F.lit(0.0)), 1).alias("avg_retention"),
        F.count(r).alias("rated_rows"),
    )


def published_by_category(content: DataFrame, analytics: DataFrame) -> DataFrame:
    """Videos, views and mean retention of published content; videos without analytics count as videos."""
    return (
        content.filter(F.col("status") == "published")
        .select(F.col("id").alias("video_id"), "category")
        .join(per_video(analytics), "video_id", "left")
        .groupBy("category")
        .agg(
            F.count("*").alias("videos"),
            F.coalesce(F.sum("views"), F.lit(0)).alias("total_views"),
            F.round(_mean(F.sum("retention_sum"), F.sum("retention_n")), 1).alias("avg_retention"),
        )
    )


def category_performance(content: DataFrame, analytics: DataFrame) -> DataFrame:
    """``published_by_category`` with the leading category flagged (equal means: the first name)."""
    table = published_by_category(content, analytics)
    rank = F.when(F.col("avg_retention").isNotNull(), F.struct((-F.col("avg_retention")).alias("r"), F.col("category").alias("c")))
    # a row per category is all that is left here
    leader = F.min(rank).over(Window.partitionBy(F.lit(0)))["c"]
    return table.withColumn("is_leader", F.coalesce(F.col("category") == leader, F.lit(False)))


def strategy_report(content: DataFrame, analytics: DataFrame, as_of: date = P.REPORT_DATE) -> DataFrame:
    """One row: period, totals, leader and laggard, findings, narrative and recommended actions."""
    rated = F.col("avg_retention").isNotNull()
    by_high = F.min(F.when(rated, F.struct((-F.col("avg_retention")).alias("r"), F.col("category").alias("c"))))
    by_low = F.min(F.when(rated, F.struct(F.col("avg_retention").alias("r"), F.col("category").alias("c"))))
    row = published_by_category(content, analytics).agg(
        F.coalesce(F.sum("videos"), F.lit(0)).alias("videos_published"),
        F.coalesce(F.sum("total_views"), F.lit(0)).alias("total_views"),
        by_high["c"].alias("leader"),
        (-by_high["r"]).alias("leader_retention"),
        by_low["c"].alias("laggard"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(rated, F.struct("category", "avg_retention"))))).alias(
            "avg_retention_by_category"
        ),
    )
    leader, laggard = F.col("leader"), F.col("laggard")
    fields = {
        "leader": leader, "laggard": laggard, "retention": F.col("leader_retention"),
        "videos": F.col("videos_published"), "views": F.col("total_views"),
    }
    told = text.fill_template(P.REPORT_TEXT, fields)
    actions = F.array(*[text.fill_template(a, fields) for a in P.REPORT_ACTIONS])
    nothing = F.lit(P.EMPTY_REPORT_TEXT)
    first_step = F.array(*[F.lit(a) for a in P.EMPTY_REPORT_ACTIONS])
    return row.select(
        week_label(F.lit(as_of)).alias("period"),
        "videos_published", "total_views", "leader", "laggard", "avg_retention_by_category",
        F.when(leader.isNotNull(), told).otherwise(nothing).alias("summary"),
        F.when(leader.isNotNull(), actions).otherwise(first_step).alias("actions"),
    )


def latest_report(reports: DataFrame) -> DataFrame:
    """The newest stored report (equal times: the higher id)."""
    return top(reports, [F.col("created_at").desc(), F.col("id").desc()], 1)


def learning_samples(memory: DataFrame, content: DataFrame) -> DataFrame:
    published = content.filter(F.col("status") == "published").select(F.col("id").alias("video_id"), "category")
    return memory.join(published, "video_id").select(
        "hook_type", "category",
        scores.duration_bucket(F.col("duration")).alias("bucket"),
        F.coalesce(F.col("performance_score"), F.lit(0)).cast("decimal(18,4)").alias("score"),
    )


def learning_groups(samples: DataFrame) -> DataFrame:
    """Mean score, samples and outcome per (kind, key) for hook, category and duration at once."""
    long = samples.select(
        "score",
        F.inline(F.array(
            F.struct(F.lit("hook").alias("kind"), F.col("hook_type").alias("key")),
            F.struct(F.lit("category").alias("kind"), F.col("category").alias("key")),
            F.struct(F.lit("duration").alias("kind"), F.col("bucket").alias("key")),
        )),
    ).filter((F.col("kind") != "hook") | text.present(F.col("key")))
    return (
        long.groupBy("kind", "key")
        .agg(F.count("*").alias("samples"), F.sum("score").alias("__total"))
        .withColumn("__avg", _mean(F.col("__total"), F.col("samples")))
        .select(
            "kind", "key", "samples",
            F.round("__avg", 1).alias("avg_score"),
            scores.outcome(F.col("__avg")).alias("outcome"),
            F.col("__avg").alias("mean_score"),
        )
    )


def learning_best(groups: DataFrame, min_samples: int = 3) -> DataFrame:
    """The strongest key of every kind among those with enough samples."""
    eligible = groups.filter(F.col("samples") >= min_samples)
    return top_per_group(eligible, ["kind"], [F.col("mean_score").desc(), F.col("key")], 1).select(
        "kind", F.col("key").alias("value"), "avg_score", "samples"
    )


def learning_memory(groups: DataFrame, min_samples: int = 3) -> DataFrame:
    """Rows for the memory table: hook and category groups with the best of their kind beside them."""
    kept = groups.filter(F.col("kind").isin("hook", "category"))
    best = F.min(F.when(
        F.col("samples") >= min_samples,
        F.struct((-F.col("mean_score")).alias("m"), F.col("key").alias("k"),
                 F.col("avg_score").alias("avg_score"), F.col("samples").alias("samples")),
    ))
    snapshot = kept.groupBy("kind").agg(best.alias("b"))
    return kept.join(snapshot, "kind").select(
        "kind", "key", "outcome", F.col("avg_score").alias("score"), "samples",
        F.when(F.col("b").isNotNull(), F.struct(
            F.col("b.k").alias("value"), F.col("b.avg_score").alias("avg_score"), F.col("b.samples").alias("samples"),
        )).alias("insight_snapshot"),
    )


def learned_rules(samples: DataFrame, min_samples: int = 3) -> DataFrame:
    """One row with the preferred hook type, category and duration bucket (NULL without enough samples)."""
    groups = learning_groups(samples)

    def best(kind: str) -> Column:
        ok = (F.col("kind") == kind) & (F.col("samples") >= min_samples)
        return F.min(F.when(ok, F.struct((-F.col("mean_score")).alias("m"), F.col("key").alias("k"))))["k"]

    return groups.agg(
        # every sample has exactly one category row
        F.coalesce(F.sum(F.when(F.col("kind") == "category", F.col("samples"))), F.lit(0)).alias("updated_from_samples"),
        best("hook").alias("prefer_hook_type"),
        best("category").alias("prefer_category_bias"),
        best("duration").alias("prefer_duration_bucket"),
    )


def mix_deficit(content: DataFrame, mix: Mapping[str, float], window: int = 8) -> DataFrame:
    """Target share minus share among the latest items, per configured category; the largest is chosen."""
    recent = top(content, [F.col("created_at").desc(), F.col("id").desc()], window).agg(
        F.collect_list(F.coalesce("category", F.lit(""))).alias("seen")  # at most ``window`` names
    )
    targets = F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(c).alias("category"), F.lit(float(t)).alias("target"))
        for i, (c, t) in enumerate(mix.items())
    ])
    n = F.greatest(F.lit(1), F.size("seen"))
    hits = lambda t: F.size(F.filter("seen", lambda x: x == t["category"]))
    rows = F.transform(targets, lambda t: F.struct(
        t["pos"].alias("pos"), t["category"].alias("category"), t["target"].alias("target"),
        hits(t).cast("long").alias("recent"), (t["target"] - hits(t) / n).alias("deficit"),
    ))
    # the first row with the largest deficit, in the order the mix is written
    widest = F.array_max(F.transform("rows", lambda r: r["deficit"]))
    best = F.element_at(F.filter("rows", lambda r: r["deficit"] == widest), 1)["pos"]
    return (
        recent.select(rows.alias("rows"))
        .select("rows", best.alias("best"))
        .select("best", F.inline("rows"))
        .select("category", "target", "recent", F.round("deficit", 4).alias("deficit"),
                (F.col("pos") == F.col("best")).alias("chosen"))
    )


def score_memory(memory: DataFrame, analytics: DataFrame) -> DataFrame:
    """``performance_score`` of each video's first memory row becomes its measured mean retention.

    Videos without measurements keep their score; ``memory`` has (id, video_id, performance_score).
    """
    measured = analytics.groupBy("video_id").agg(
        F.round(F.sum(F.col("retention").cast("decimal(18,4)")).cast("double") / F.count("retention"), 1).alias("performance_score"))
    first = memory.groupBy("video_id").agg(F.min("id").alias("id"))
    changes = first.join(measured.filter(F.col("performance_score").isNotNull()), "video_id").select("id", "performance_score")
    return keyed_update(memory, changes, "id", ["performance_score"])
