"""Listings, audit, updates, review queue, manifest and calendar."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from castwise import params as P
from castwise.catalog.base import joined, query, table, view
from castwise.functions import scores
from castwise.operators import joins
from castwise.plans import audit, packaging, review, schedule

_TOTAL = """round((1.0 * virality + 1.2 * least(100, curiosity) + 1.0 * evergreen + 1.0 * educational
    + 0.8 * emotional - 1.0 * competition)::double / 5.0, 1)"""


@query("latest_content", """
    select id, case when coalesce(title, '') = '' then topic else title end as title, topic, category, status, quality_score,
           video_format as format, strftime(created_at, '%Y-%m-%dT%H:%M:%S') as created_at
    from content_v order by content_v.created_at desc, id desc limit 50
""", ["content_v"])
def latest_content(spark, folder):
    return audit.latest_content(view(spark, folder, "content_v"))


@query("top_topics", f"""
    with t as (select *, {_TOTAL} as total from topics_v)
    select topic_id, case when angle = '' then topic else angle end as label, category, total, status
    from t order by total desc, topic_id limit 50
""", ["topics_v"])
def top_topics(spark, folder):
    rows = view(spark, folder, "topics_v")
    dims = ("virality", "curiosity", "evergreen", "educational", "emotional", "competition")
    return audit.top_topics(rows.withColumn("total", scores.topic_total({d: F.col(d) for d in dims})))


@query("recent_runs", """
    select id, run_id, agent, status, duration_ms, strftime(created_at, '%Y-%m-%dT%H:%M:%S') as created_at
    from runs_v order by runs_v.created_at desc, id desc limit 40
""", ["runs_v"])
def recent_runs(spark, folder):
    return audit.recent_runs(view(spark, folder, "runs_v"))


@query("run_audit", """
    select agent, status, count(*) as runs, cast(sum(duration_ms) as bigint) as total_ms from runs_v group by all
""", ["runs_v"])
def run_audit(spark, folder):
    return audit.run_counts(view(spark, folder, "runs_v"))


@query("audit_rows", """
    select page_id as run_id, 'crawl' as agent, 'success' as status, cast(length(html) as bigint) as duration_ms,
           cast(1 as bigint) as attempts,
           left(url, 500) || case when length(url) > 500 then '…' else '' end as input_summary,
           left(html, 500) || case when length(html) > 500 then '…' else '' end as output_summary
    from pages
""")
def audit_rows(spark, folder):
    pages = table(spark, folder, "pages")
    return audit.audit_rows(pages.select(
        F.col("page_id").alias("run_id"), F.lit("crawl").alias("agent"), F.lit("success").alias("status"),
        F.length("html").cast("long").alias("duration_ms"), F.lit(1).cast("long").alias("attempts"),
        F.col("url").alias("payload"), F.col("html").alias("output"),
    ))


@query("status_check", """
    select o_orderstatus as status, count(*) as rows from orders
    where o_orderstatus is null or o_orderstatus not in ('published', 'in_review') group by 1
""")
def status_check(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_orderstatus").alias("status"))
    return audit.unknown_statuses(orders)


@query("content_by_ids", """
    select id, topic, status from content_v
    where status in ('published', 'in_review') and id in (select l_partkey from lineitem where l_quantity > 49)
      and id <> coalesce(cast(null as bigint), -1)
""", ["content_v"])
def content_by_ids(spark, folder):
    """Status list, id list (a table, so a semi join) and not-equal with a default for a missing id."""
    ids = table(spark, folder, "lineitem").filter(F.col("l_quantity") > 49).select(F.col("l_partkey").alias("id"))
    content = view(spark, folder, "content_v").filter(F.col("status").isin("published", "in_review"))
    own_id = F.lit(None).cast("long")
    return content.filter(F.col("id") != F.coalesce(own_id, F.lit(-1))).join(ids, "id", "left_semi").select("id", "topic", "status")


@query("keyed_update", """
    with ch as (
      select id, status from (
        select l_partkey as id, case when l_returnflag = 'R' then 'rejected' else 'approved' end as status,
               row_number() over (partition by l_partkey order by l_shipdate desc,
                 case when l_returnflag = 'R' then 'rejected' else 'approved' end) as rn
        from lineitem where l_quantity > 45) where rn = 1)
    select c.id, c.topic, coalesce(ch.status, c.status) as status from content_v c left join ch on ch.id = c.id
""", ["content_v"])
def keyed_update(spark, folder):
    changes = table(spark, folder, "lineitem").filter(F.col("l_quantity") > 45).select(
        F.col("l_partkey").alias("id"), "l_shipdate",
        F.when(F.col("l_returnflag") == "R", "rejected").otherwise("approved").alias("status"),
    )
    content = view(spark, folder, "content_v").select("id", "topic", "status")
    return joins.keyed_update(content, changes, "id", ["status"], [F.col("l_shipdate").desc(), F.col("status")])


@query("insert_if_absent", """
    with old as (select distinct video_id from memory_v where duration is not null),
    new as (select l_partkey as video_id, min(l_orderkey) as first_order from lineitem group by 1)
    select video_id, first_order from new where video_id not in (select video_id from old)
""", ["memory_v"])
def insert_if_absent(spark, folder):
    old = view(spark, folder, "memory_v").filter(F.col("duration").isNotNull())
    new = table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("video_id")).agg(
        F.min("l_orderkey").alias("first_order"))
    return joins.insert_if_absent(old, new, "video_id")


@query("first_match", """
    with m as (select l_partkey as id, l_orderkey as first_order, l_linenumber as line,
                 row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey) as rn from lineitem)
    select c.id, c.topic, m.first_order, m.line from content_v c left join m on m.id = c.id and m.rn = 1
""", ["content_v"])
def first_match(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("first_order"), F.col("l_linenumber").alias("line"), "l_suppkey")
    order = [F.col("first_order"), F.col("line"), F.col("l_suppkey")]
    content = view(spark, folder, "content_v").select("id", "topic")
    return joins.first_match(content, lines, "id", order).drop("l_suppkey")


@query("position_zip", """
    with o as (select o_custkey, o_orderkey, o_orderdate,
                 row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as position from orders),
    e as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as position from events)
    select o_custkey as channel_id, o_orderkey, event_id, o.position
    from o join e on e.user_id = o.o_custkey and e.position = o.position
""")
def position_zip(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("channel_id"), "o_orderkey", "o_orderdate")
    events = table(spark, folder, "events").select(F.col("user_id").alias("channel_id"), "event_id", "ts")
    pairs = joins.zip_by_position(
        orders, events, ["channel_id"], [F.col("o_orderdate"), F.col("o_orderkey")], [F.col("ts"), F.col("event_id")])
    return pairs.select("channel_id", "o_orderkey", "event_id", "position")


def _records(spark, folder):
    content = view(spark, folder, "content_v")
    items = content.select(
        F.concat(F.lit("run-"), F.col("id").cast("string")).alias("run_id"), F.col("id").alias("content_id"),
        F.concat_ws(" ", "topic", "category", "subcategory", "status", "video_format").alias("title"),
        "category", F.col("video_format").alias("format"), (F.col("status") == "published").alias("quality_passed"),
        F.when(F.col("id") % 4 != 0, F.create_map(F.lit("overall"), F.col("quality_score"))).alias("scorecard"),
    )
    decisions = table(spark, folder, "lineitem").filter(F.col("l_quantity") > 40).select(
        F.concat(F.lit("run-"), F.col("l_partkey").cast("string")).alias("run_id"),
        F.when(F.col("l_returnflag") == "R", "rejected").otherwise("approved").alias("review_status"),
        F.col("l_shipdate").alias("reviewed_at"),
    )
    return review.decide(review.bundles(items), decisions)


_RECORDS = """
    with d as (
      select run_id, review_status from (
        select 'run-' || l_partkey as run_id, case when l_returnflag = 'R' then 'rejected' else 'approved' end as review_status,
          row_number() over (partition by l_partkey order by l_shipdate desc,
            case when l_returnflag = 'R' then 'rejected' else 'approved' end) as rn
        from lineitem where l_quantity > 40) where rn = 1),
    r as (
      select 'run-' || c.id as run_id, c.id as content_id, concat_ws(' ', topic, category, subcategory, status, video_format) as title,
             video_format as format, case when c.id % 4 <> 0 then quality_score end as overall,
             coalesce(d.review_status, 'pending') as review_status
      from content_v c left join d on d.run_id = 'run-' || c.id)
"""


@query("review_queue", _RECORDS + """
    select run_id, review_status, format, coalesce(cast(overall as varchar), '-') as overall, left(title, 44) as title from r
""", ["content_v"])
def review_queue(spark, folder):
    return review.listing(_records(spark, folder))


@query("review_to_content", _RECORDS + """
    select c.id, case when r.review_status in ('approved', 'rejected') then r.review_status
                      when c.status <> 'published' then 'in_review' else c.status end as status
    from content_v c left join r on r.content_id = c.id
""", ["content_v"])
def review_to_content(spark, folder):
    records = _records(spark, folder)
    content = view(spark, folder, "content_v").select("id", "status")
    return review.apply_to_content(review.mark_in_review(content, records), records)


@query("approved_runs", _RECORDS + """
    select run_id, content_id from r where review_status = 'approved'
      and run_id in (select 'run-' || user_id from events where event_type = 'purchase')
""", ["content_v"])
def approved_runs(spark, folder):
    checkpoints = table(spark, folder, "events").filter(F.col("event_type") == "purchase").select(
        F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"))
    return review.approved_runs(_records(spark, folder), checkpoints).select("run_id", "content_id")


def _packaged(spark, folder):
    content = view(spark, folder, "content_v")
    topic = F.concat_ws(" ", "topic", "for", "category")
    items = content.withColumn("for", F.lit("with the")).select(
        "id", topic.alias("topic"), "category",
        F.repeat(F.concat(topic, F.lit("; ")), (F.col("id") % 7 + 1).cast("int")).alias("title"),
        packaging.default_description(topic, "house", "Follow for more.").alias("description"),
        F.when(F.col("id") % 2 == 0, F.lit("Narrated by an AI-generated presenter.")).alias("disclosure"),
    )
    return packaging.platform_metadata(items, platforms=("youtube", "tiktok", "instagram", "facebook", "vimeo"))


_PACKAGED = """
    with p(platform, title_max, desc_max, tags, hashtags, hint, opener) as (values
      ('youtube', 100, 4800, 15, 3, 'watch time + search', ''),
      ('tiktok', 100, 2000, 8, 5, 'first-3s retention', 'Wait for the twist. '),
      ('instagram', 90, 2000, 8, 8, 'saves + shares', 'Save this for later. '),
      ('facebook', 100, 4000, 10, 3, 'shares + comments', 'Share this with someone who loves history. '),
      ('vimeo', 100, 2000, 10, 3, '', '')),
    i as (
      select id, category, topic || ' with the ' || category as topic,
             repeat(topic || ' with the ' || category || '; ', cast(id % 7 + 1 as int)) as title from content_v),
    j as (
      select *, 'A house documentary about ' || topic || '. Follow for more.'
          || case when id % 2 = 0 then '\n\nNarrated by an AI-generated presenter.' else '' end as told,
        list_concat(regexp_extract_all(lower(topic), '[a-z]{4,}'),
          [category, 'documentary', 'education', 'facts', 'explained', 'story']) as raw_words from i),
    k as (
      select *, list_filter(raw_words, lambda w, n: list_position(raw_words, w) = n) as words from j),
    m as (
      select k.id, p.platform, k.category,
        case when length(title) <= title_max then title
             else regexp_replace(left(title, title_max - 1), '\\s+$', '') || '…' end as title,
        regexp_replace(opener || told, '^\\s+|\\s+$', '', 'g')
          || case when hint <> '' then '\n\n[optimized for: ' || hint || ']' else '' end as description,
        array_to_string(words[1:p.tags], '|') as tags,
        array_to_string((['#channel', '#psychology', '#history', '#documentary', '#learnontiktok']
          || ['#' || category || 'facts', '#storytime', '#didyouknow'])[1:p.hashtags], '|') as hashtags
      from k, p)
"""


@query("platform_metadata", _PACKAGED + "select * from m", ["content_v"])
def platform_metadata(spark, folder):
    rows = _packaged(spark, folder)
    return rows.select("id", "platform", "category", "title", "description", joined("tags"), joined("hashtags"))


def _results(spark, folder):
    return packaging.publish_results(_packaged(spark, folder), dry_run=False, configured=("facebook",))


_RESULTS = _PACKAGED + """,
    s as (
      select id, platform, title,
        case platform when 'vimeo' then 'skipped' when 'facebook' then 'eligible' else 'dry_run' end as status,
        case platform when 'vimeo' then 'no publisher plugin' when 'facebook' then ''
          when 'youtube' then 'missing credentials: YOUTUBE_CLIENT_ID, YOUTUBE_CLIENT_SECRET, YOUTUBE_REFRESH_TOKEN'
          when 'tiktok' then 'missing credentials: TIKTOK_ACCESS_TOKEN'
          else 'missing credentials: INSTAGRAM_USER_ID, INSTAGRAM_ACCESS_TOKEN' end as note
      from m)
"""


@query("publish_results", _RESULTS + "select * from s", ["content_v"])
def publish_results(spark, folder):
    return _results(spark, folder).select("id", "platform", "title", "status", "note")


@query("publish_manifest", _RESULTS + """
    select id, count(*)::integer as packages, string_agg(platform || '=' || status, '|' order by platform) as statuses,
           bool_or(status in ('published', 'dry_run')) as published from s group by id
""", ["content_v"])
def publish_manifest(spark, folder):
    rows = packaging.publish_manifest(_results(spark, folder))
    states = F.transform("results", lambda r: F.concat(r["platform"], F.lit("="), r["status"]))
    return rows.select("id", F.size("packages").alias("packages"), F.array_join(states, "|").alias("statuses"), "published")


# ------------------------------------------------------------------ calendar

RULES = replace(P.CalendarRules(), mix={"psychology": 0.55, "history": 0.45}, days=42)


def _channels(spark, folder):
    return table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("channel_id")).agg(
        F.to_date(F.min("o_orderdate")).alias("start"))


_PSY = "['human behavior', 'cognitive biases', 'relationships', 'personality', 'habits', 'decision making', 'leadership', " \
       "'communication', 'emotional intelligence', 'motivation', 'fear', 'confidence', 'social psychology']"
_HIS = "['ancient civilizations', 'lost kingdoms', 'empires', 'famous leaders', 'historical mysteries', 'wars', 'discoveries', " \
       "'inventions', 'cultural history', 'forgotten events']"
_CALENDAR = f"""
    with ch as (select o_custkey as channel_id, cast(min(o_orderdate) as date) as start from orders group by 1),
    days as (select channel_id, cast(start + cast(i as integer) as date) as d from ch, range(42) r(i)),
    slots as (
      select channel_id, d, case when isodow(d) = 7 then 'long' else 'short' end as format,
             row_number() over (partition by channel_id order by d) - 1 as slot,
             count(*) over (partition by channel_id) as n
      from days where isodow(d) in (1, 3, 5, 7)),
    sizes as (select distinct channel_id, n, floor(0.55::double * n) as pf, floor(0.45::double * n) as hf from slots),
    counts as (
      select channel_id, n,
        pf + case when pf + hf < n and (0.55::double * n - pf) >= (0.45::double * n - hf) then 1 else 0 end as p,
        hf + case when pf + hf < n and (0.55::double * n - pf) < (0.45::double * n - hf) then 1 else 0 end as h from sizes),
    picks as (
      select channel_id, n, p, h, 0 as c, r as remaining, p - r as turn from counts, range(1, 60) t(r) where r <= p
      union all select channel_id, n, p, h, 1, r, h - r from counts, range(1, 60) t(r) where r <= h),
    seq as (
      select *, row_number() over (partition by channel_id order by remaining desc,
          case when cast(n - 2 * least(p, h) as bigint) % 2 = 0 then c else 1 - c end) - 1 as slot from picks),
    cal as (
      select s.channel_id, cast(s.slot as integer) as slot, cast(d as varchar) as date, strftime(d, '%a') as weekday,
        case c when 0 then 'psychology' else 'history' end as category,
        case c when 0 then ({_PSY})[cast(turn as bigint) % 13 + 1] else ({_HIS})[cast(turn as bigint) % 10 + 1] end as subcategory,
        format
      from slots s join seq q on q.channel_id = s.channel_id and q.slot = s.slot)
"""


@query("calendar", _CALENDAR + "select * from cal")
def calendar(spark, folder):
    return schedule.calendar(_channels(spark, folder), RULES)


@query("calendar_batch", _CALENDAR + """
    select channel_id, date, category, subcategory, cast(rn as integer) as batch_position from (
      select *, row_number() over (partition by channel_id order by slot) as rn from cal
      where category = 'history' and format = 'short') where rn <= 3
""")
def calendar_batch(spark, folder):
    slots = schedule.calendar(_channels(spark, folder), RULES)
    return schedule.plan_batch(slots, 3, "history", "short").select(
        "channel_id", "date", "category", "subcategory", "batch_position")


@query("calendar_quality", _CALENDAR + """
    select channel_id, count(*) as slots, count(*) filter (category = 'psychology') as psychology_slots,
           count(*) filter (same) as adjacent_repeats
    from (select *, coalesce(lag(category) over w = category and lag(subcategory) over w = subcategory, false) as same
          from cal window w as (partition by channel_id order by slot)) group by channel_id
""")
def calendar_quality(spark, folder):
    return schedule.adjacent_repeats(schedule.calendar(_channels(spark, folder), RULES))
