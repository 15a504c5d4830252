"""Performance, learning and mix."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from castwise.catalog.base import query, table, view
from castwise.plans import performance as perf
from castwise.session import scratch_dir
from castwise.streaming import summaries as live

MIX = {"ECONOMY": 0.3, "SMALL": 0.3, "PROMO": 0.2, "STANDARD": 0.2}


@query("category_performance", """
    with per as (
      select c.category, count(distinct c.id) as videos, coalesce(sum(a.views), 0) as views, avg(a.retention) as r
      from content_v c left join analytics_v a on a.video_id = c.id
      where c.status = 'published' group by c.category),
    best as (select category from per where r is not null order by round(r, 1) desc, category limit 1)
    select category, videos, cast(views as bigint) as total_views, round(r, 1) as avg_retention,
           coalesce(category = (select category from best), false) as is_leader
    from per
""", ["content_v", "analytics_v"])
def category_performance(spark, folder):
    return perf.category_performance(view(spark, folder, "content_v"), view(spark, folder, "analytics_v"))


@query("analytics_summary", """
    select (select count(*) from content_v where status = 'published') as published,
           (select count(*) from content_v) as items,
           (select cast(coalesce(sum(views), 0) as bigint) from analytics_v) as total_views,
           (select round(coalesce(avg(retention), 0.0), 1) from analytics_v) as avg_retention
""", ["content_v", "analytics_v"])
def analytics_summary(spark, folder):
    return perf.analytics_summary(view(spark, folder, "content_v"), view(spark, folder, "analytics_v"))


@query("category_retention_any_status", """
    select c.category, round(avg(a.retention), 1) as avg_retention
    from content_v c join analytics_v a on a.video_id = c.id group by c.category
""", ["content_v", "analytics_v"])
def category_retention_any_status(spark, folder):
    return perf.retention_by_category(view(spark, folder, "content_v"), view(spark, folder, "analytics_v"))


@query("retention_nonzero", """
    select round(avg(retention), 1) as avg_retention, count(*) as rated_rows
    from analytics_v where retention is not null and retention <> 0
""", ["analytics_v"])
def retention_nonzero(spark, folder):
    return perf.retention_nonzero(view(spark, folder, "analytics_v"))


@query("strategy_report", """
    with per as (
      select c.category, round(avg(a.retention), 1) as r
      from content_v c join analytics_v a on a.video_id = c.id where c.status = 'published' group by 1),
    tot as (
      select (select count(*) from content_v where status = 'published') as n,
             (select cast(coalesce(sum(a.views), 0) as bigint) from content_v c join analytics_v a on a.video_id = c.id
              where c.status = 'published') as v),
    hi as (select * from per order by r desc, category limit 1),
    lo as (select * from per order by r, category limit 1)
    select strftime(date '2024-01-31', '%Y-W%W') as period, tot.n as videos_published, tot.v as total_views,
           hi.category as leader, lo.category as laggard,
           (select string_agg(category || '=' || r, '|' order by category) from per) as findings,
           'This period, ' || hi.category || ' content led on average retention (' || hi.r || '%). ' || tot.n
             || ' videos published, ' || tot.v || ' total views.' as summary,
           'Increase share of ''' || hi.category || ''' topics slightly next cycle.|Tighten intros on ''' || lo.category
             || ''' content to lift early retention.|Keep shorts under 70s; front-load the hook in the first 3 seconds.'
             as actions
    from tot, hi, lo
""", ["content_v", "analytics_v"])
def strategy_report(spark, folder):
    report = perf.strategy_report(view(spark, folder, "content_v"), view(spark, folder, "analytics_v"))
    findings = F.transform(
        F.array_sort(F.map_entries("avg_retention_by_category")),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
    )
    return report.select(
        "period", "videos_published", "total_views", "leader", "laggard",
        F.array_join(findings, "|").alias("findings"), "summary", F.array_join("actions", "|").alias("actions"),
    )


def _samples(spark, folder):
    return perf.learning_samples(view(spark, folder, "memory_v"), view(spark, folder, "content_v"))


_LEARN = """
    with s as (
      select m.hook_type, c.category, coalesce(m.performance_score, 0) as score,
             case when coalesce(m.duration, 0) <= 30 then '0-30s' when coalesce(m.duration, 0) <= 60 then '30-60s'
                  when coalesce(m.duration, 0) <= 90 then '60-90s' else '90s+' end as bucket
      from memory_v m join content_v c on c.id = m.video_id where c.status = 'published'),
    g as (
      select 'hook' as kind, hook_type as key, count(*) as samples, avg(score) as m from s where hook_type <> '' group by 2
      union all select 'category', category, count(*), avg(score) from s group by 2
      union all select 'duration', bucket, count(*), avg(score) from s group by 2),
    b as (select *, row_number() over (partition by kind order by m desc, key) as rn from g where samples >= 3)
"""


@query("learning_groups", _LEARN + """
    select kind, key, samples, round(m, 1) as avg_score, case when m >= 60 then 'worked' else 'failed' end as outcome from g
""", ["memory_v", "content_v"])
def learning_groups(spark, folder):
    return perf.learning_groups(_samples(spark, folder)).drop("mean_score")


@query("learning_best", _LEARN + """
    select kind, key as value, round(m, 1) as avg_score, samples from b where rn = 1
""", ["memory_v", "content_v"])
def learning_best(spark, folder):
    return perf.learning_best(perf.learning_groups(_samples(spark, folder)))


@query("learning_memory", _LEARN + """
    select g.kind, g.key, case when g.m >= 60 then 'worked' else 'failed' end as outcome, round(g.m, 1) as score,
           g.samples, b.key as best_value, round(b.m, 1) as best_score
    from g left join b on b.kind = g.kind and b.rn = 1 where g.kind in ('hook', 'category')
""", ["memory_v", "content_v"])
def learning_memory(spark, folder):
    return perf.learning_memory(perf.learning_groups(_samples(spark, folder))).select(
        "kind", "key", "outcome", "score", "samples",
        F.col("insight_snapshot.value").alias("best_value"), F.col("insight_snapshot.avg_score").alias("best_score"),
    )


@query("learned_rules", _LEARN + """
    select (select count(*) from s) as updated_from_samples,
           (select key from b where kind = 'hook' and rn = 1) as prefer_hook_type,
           (select key from b where kind = 'category' and rn = 1) as prefer_category_bias,
           (select key from b where kind = 'duration' and rn = 1) as prefer_duration_bucket
""", ["memory_v", "content_v"])
def learned_rules(spark, folder):
    return perf.learned_rules(_samples(spark, folder))


@query("mix_deficit", """
    with recent as (select category from content_v order by created_at desc, id desc limit 8),
    target(pos, category, target) as (values (0, 'ECONOMY', 0.3), (1, 'SMALL', 0.3), (2, 'PROMO', 0.2), (3, 'STANDARD', 0.2)),
    d as (
      select pos, category, cast(target as double) as target,
             (select count(*) from recent r where r.category = t.category) as recent from target t),
    e as (select *, target - recent / greatest(1, (select count(*) from recent)) as raw from d)
    select category, target, recent, round(raw, 4) as deficit,
           row_number() over (order by raw desc, pos) = 1 as chosen from e
""", ["content_v"])
def mix_deficit(spark, folder):
    return perf.mix_deficit(view(spark, folder, "content_v"), MIX)


@query("stream_summary", """
    select c.category, count(*) as rows, cast(sum(a.views) as bigint) as total_views, round(avg(a.retention), 1) as avg_retention
    from content_v c join analytics_v a on a.video_id = c.id group by c.category
""", ["content_v", "analytics_v"])
def stream_summary(spark, folder):
    lines = live.arriving(spark, f"{folder}/{{lineitem}}.parquet", table(spark, folder, "lineitem"))
    analytics = lines.select(
        F.col("l_partkey").alias("video_id"), F.col("l_quantity").cast("long").alias("views"),
        F.round(F.col("l_discount") * 1000).cast("long").alias("retention"),
    )
    return live.retention_by_category(analytics, view(spark, folder, "content_v"), "summary")


@query("stream_audit", "select agent, status, count(*) as runs from runs_v group by all", ["runs_v"])
def stream_audit(spark, folder):
    events = live.arriving(spark, f"{folder}/{{events}}.parquet", table(spark, folder, "events"))
    runs = events.select(
        F.col("event_type").alias("agent"),
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
    )
    return live.drain(live.run_counts(runs), "audit")


@query("stream_append", """
    select agent, count(*) as rows, cast(sum(duration_ms) as bigint) as total_ms from runs_v group by 1
""", ["runs_v"])
def stream_append(spark, folder):
    """Arriving runs appended to a table; the second start finds nothing new and adds nothing."""
    base = f"{scratch_dir(spark)}/castwise/stream-append-{uuid.uuid4().hex}"
    for _ in range(2):
        events = live.arriving(spark, f"{folder}/{{events}}.parquet", table(spark, folder, "events"))
        rows = events.select(
            F.col("event_type").alias("agent"), F.floor(F.col("value") * 10).cast("long").alias("duration_ms"))
        live.append_stream(rows, f"{base}/table", "runs", f"{base}/progress")
    return spark.read.parquet(f"{base}/table").groupBy("agent").agg(
        F.count("*").alias("rows"), F.sum("duration_ms").alias("total_ms"))
