"""Landed payloads, image pools and credits, and write-then-read round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from castwise import schemas
from castwise.catalog.base import query, table, view
from castwise.functions import text
from castwise.operators.joins import keyed_update
from castwise.plans import packaging
from castwise.session import scratch_dir
from castwise.sources import payloads, readers, writers


@query("post_listing", """
    with e as (select event_id, event_type, cast(json_extract(props, '$.k') as bigint) as k from events)
    select event_id, 0::integer as position, event_type || ' of the day' as title, k * 100 as ups from e
    union all select event_id, 1, '', 0 from e
""")
def post_listing(spark, folder):
    """Listings are built from the event table (two posts each, the second without title and votes)."""
    ups = payloads.json_field(F.col("props"), "$.k").cast("long") * 100
    post = lambda title, votes: F.struct(F.struct(title.alias("title"), votes.alias("ups")).alias("data"))
    none = F.lit(None)
    body = F.to_json(F.struct(F.struct(F.array(
        post(F.concat("event_type", F.lit(" of the day")), ups), post(none.cast("string"), none.cast("long")),
    ).alias("children")).alias("data")))
    landed = table(spark, folder, "events").select("event_id", body.alias("body"))
    return payloads.posts(landed, "event_id", "body")


@query("media_listing", r"""
    with p as (select page_id, url, html, unnest([0, 1, 2]) as position from pages),
    q as (select page_id, position, case position when 0 then url || '/thumb' when 1 then url else '' end as u,
            case position when 0 then 'File:' || page_id || '.jpg' else page_id || '.png' end as title,
            case when position = 0 and page_id % 3 = 0 then '' when position = 1 and page_id % 2 = 0 then 'All rights reserved' else 'CC BY-SA 4.0' end as lic,
            left(regexp_replace(html, '<[^>]+>', '', 'g'), 120) as credit from p)
    select page_id, position::integer as position, u as url, replace(title, 'File:', '') as title,
           case when lic = '' then 'see Commons' else lic end as license, credit, 'Wikimedia Commons' as source
    from q where u <> '' and (lic = '' or regexp_matches(lic, '(?i)public domain|cc|pd'))
""")
def media_listing(spark, folder):
    pid = F.col("page_id").cast("string")

    def file(title, thumb, url, license):
        return F.struct(title.alias("title"), F.array(F.struct(
            thumb.alias("thumburl"), url.alias("url"),
            F.struct(F.struct(license.alias("value")).alias("LicenseShortName"), F.struct(F.col("html").alias("value")).alias("Artist"))
            .alias("extmetadata"),
        )).alias("imageinfo"))

    by_sa, no = F.lit("CC BY-SA 4.0"), F.lit(None).cast("string")
    files = F.create_map(
        F.lit("11"), file(F.concat(F.lit("File:"), pid, F.lit(".jpg")), F.concat("url", F.lit("/thumb")), F.col("url"),
                          F.when(F.col("page_id") % 3 == 0, "").otherwise(by_sa)),
        F.lit("12"), file(F.concat(pid, F.lit(".png")), no, F.col("url"),
                          F.when(F.col("page_id") % 2 == 0, "All rights reserved").otherwise(by_sa)),
        F.lit("13"), file(F.concat(pid, F.lit(".png")), F.lit(""), no, by_sa),
    )
    body = F.to_json(F.struct(F.struct(files.alias("pages")).alias("query")))
    landed = table(spark, folder, "pages").select("page_id", body.alias("body"))
    return payloads.media_files(landed, "page_id", "body")


@query("image_listing", """
    select page_id, 0::integer as position, url, 'query ' || page_id as title, 'CC' as license, '' as credit, 'Openverse' as source from pages
    union all
    select page_id, 1, url || '/2', 'A title', 'BY-NC', 'someone', 'museum' from pages where page_id % 2 = 1
""")
def image_listing(spark, folder):
    cell = lambda url, title, lic, who, src: F.struct(
        url.alias("url"), title.alias("title"), lic.alias("license"), who.alias("creator"), src.alias("source"))
    no = F.lit(None).cast("string")
    second = F.when(F.col("page_id") % 2 == 1, F.concat("url", F.lit("/2"))).otherwise("")
    results = F.array(cell(F.col("url"), F.lit(""), no, no, F.lit("")),
                      cell(second, F.lit("A title"), F.lit("by-nc"), F.lit("someone"), F.lit("museum")))
    landed = table(spark, folder, "pages").select("page_id", F.to_json(F.struct(results.alias("results"))).alias("body"))
    return payloads.image_results(landed, "page_id", "body", F.concat(F.lit("query "), F.col("page_id").cast("string")))


@query("json_payload", """
    select event_id, case when event_id % 4 = 3 then null else cast(json_extract(props, '$.k') as bigint) end as k,
           event_id % 4 <> 3 as has_json from events
""")
def json_payload(spark, folder):
    """Replies wrap the event properties in a fence, in prose, or not at all; every fourth is no JSON."""
    kind = F.col("event_id") % 4
    reply = (
        F.when(kind == 0, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\nDone.")))
        .when(kind == 1, F.concat(F.lit("Here it is "), "props", F.lit(" as asked")))
        .when(kind == 2, F.concat(F.lit("  "), "props", F.lit("\n")))
        .otherwise(F.concat(F.lit("Sorry {no"), F.replace("props", F.lit('"'), F.lit("")), F.lit(" idea")))
    )
    found = table(spark, folder, "events").select("event_id", text.json_in_reply(reply).alias("j"))
    return found.select("event_id", payloads.json_field(F.col("j"), "$.k").cast("long").alias("k"), F.col("j").isNotNull().alias("has_json"))


@query("page_text", """
    select page_id, regexp_replace(html, '<[^>]+>', '', 'g') as plain, left(regexp_replace(html, '<[^>]+>', '', 'g'), 120) as credit from pages
""")
def page_text(spark, folder):
    plain = text.strip_tags(F.col("html"))
    return table(spark, folder, "pages").select("page_id", plain.alias("plain"), F.left(plain, F.lit(120)).alias("credit"))


_HITS = """
    select l_orderkey as topic_id, l_linenumber % 3 as query_rank, case l_returnflag when 'A' then 0 else 1 end as provider_rank,
           l_linenumber as position, 'http://img/' || l_partkey % 5 as url, 'part ' || l_suppkey as title from lineitem
"""


def _hits(spark, folder):
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("topic_id"), (F.col("l_linenumber") % 3).alias("query_rank"),
        F.when(F.col("l_returnflag") == "A", 0).otherwise(1).alias("provider_rank"), F.col("l_linenumber").alias("position"),
        F.concat(F.lit("http://img/"), (F.col("l_partkey") % 5).cast("string")).alias("url"),
        F.concat(F.lit("part "), F.col("l_suppkey").cast("string")).alias("title"))


@query("image_pool", f"""
    with h as ({_HITS}),
    f as (select * from (select *, row_number() over (partition by topic_id, url order by query_rank, provider_rank, position, title) as k from h) where k = 1)
    select topic_id, url, title, cast(rn as integer) as pool_index from (
      select *, row_number() over (partition by topic_id order by query_rank, provider_rank, position, title, url) as rn from f) where rn <= 3
""")
def image_pool(spark, folder):
    return packaging.image_pool(_hits(spark, folder), 3).select("topic_id", "url", "title", "pool_index")


@query("credit_lines", f"""
    with c as (select topic_id as run_id, title, case when provider_rank = 0 then 'Wikimedia Commons' else 'Openverse' end as source,
                 case when position % 2 = 0 then '' else 'author ' || position end as credit, 'CC0' as license, position from ({_HITS})),
    f as (select * from (select *, row_number() over (partition by run_id, title, source order by position, credit, license) as k from c) where k = 1)
    select run_id, position, '- ' || title || case when credit <> '' then ' by ' || credit else '' end || ' — ' || source || ' (' || license || ')' as line from f
""")
def credit_lines(spark, folder):
    credits = _hits(spark, folder).select(
        F.col("topic_id").alias("run_id"), "title", "position",
        F.when(F.col("provider_rank") == 0, "Wikimedia Commons").otherwise("Openverse").alias("source"),
        F.when(F.col("position") % 2 == 0, "").otherwise(F.concat(F.lit("author "), F.col("position").cast("string"))).alias("credit"),
        F.lit("CC0").alias("license"))
    return packaging.credit_lines(credits)


# ------------------------------------------------------------------ round trips

def _folder(spark, label: str) -> str:
    return f"{scratch_dir(spark)}/castwise/{label}-{uuid.uuid4().hex}"


@query("append_replay", """
    select platform, 'batch-' || video_id % 2 as batch_id, count(*) as rows, cast(sum(views) as bigint) as views from analytics_v group by all
""", ["analytics_v"])
def append_replay(spark, folder):
    """Two batches are appended and the second one is sent again: nothing is counted twice."""
    rows = view(spark, folder, "analytics_v").select("video_id", "platform", "views")
    path = _folder(spark, "append")
    for batch in (0, 1, 1):
        writers.append_batch(rows.filter(F.col("video_id") % 2 == batch), path, f"batch-{batch}", ["platform"])
    return spark.read.parquet(path).groupBy("platform", F.col("batch_id").cast("string").alias("batch_id")).agg(
        F.count("*").alias("rows"), F.sum("views").alias("views"))


@query("partition_rewrite", """
    with ch as (select l_partkey as id, max(l_linenumber) as n from lineitem where l_quantity > 45 group by 1)
    select c.id, c.category, case when c.category <> 'ECONOMY' then c.status else coalesce('step-' || ch.n, c.status) end as status
    from content_v c left join ch using (id)
""", ["content_v"])
def partition_rewrite(spark, folder):
    """A keyed update of one category rewrites that partition and leaves the others alone (``status_update`` changes all)."""
    path = _folder(spark, "rewrite")
    writers.replace_partitions(view(spark, folder, "content_v").select("id", "status", "category"), path, ["category"])
    changes = table(spark, folder, "lineitem").filter("l_quantity > 45").groupBy(F.col("l_partkey").alias("id")).agg(
        F.concat(F.lit("step-"), F.max("l_linenumber").cast("string")).alias("status"))
    stored = spark.read.parquet(path).filter(F.col("category") == "ECONOMY")
    from castwise.session import staged

    # read and written are the same folder, so the new rows are finished before the old ones go
    writers.replace_partitions(staged(keyed_update(stored, changes, "id", ["status"]), "rewrite"), path, ["category"])
    return spark.read.parquet(path).select("id", "category", "status")


@query("bundle_scan", """
    with r as (select 'run-' || id as run_id, id as content_id, status, topic as title, case when id % 3 <> 0 then quality_score end as overall from content_v)
    select r.run_id, r.content_id, r.title, r.overall, e.stages from r
    join (select 'run-' || user_id as run_id, count(*) as stages from events group by 1) e using (run_id) where r.status = 'published'
""", ["content_v"])
def bundle_scan(spark, folder):
    """Review records written as JSON, scanned by pattern with a fixed schema, joined with their checkpoints."""
    path = _folder(spark, "bundles")
    content = view(spark, folder, "content_v")
    writers.json_report(content.select(
        F.concat(F.lit("run-"), F.col("id").cast("string")).alias("run_id"), F.col("id").alias("content_id"), "status",
        F.col("topic").alias("title"), "category",
        F.when(F.col("id") % 3 != 0, F.create_map(F.lit("overall"), F.col("quality_score"))).alias("scorecard"),
    ), path, ["category"])
    records = spark.read.schema(schemas.REVIEW_RECORD).json(f"{path}/*/*.json")
    runs = table(spark, folder, "events").groupBy(F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id")).agg(
        F.count("*").alias("stages"))
    return records.filter(F.col("status") == "published").join(runs, "run_id").select(
        "run_id", "content_id", "title", F.try_element_at("scorecard", F.lit("overall")).alias("overall"), "stages")


@query("caption_sink", """
    select user_id as run_id, string_agg(event_type, chr(10) order by event_id) as text from events group by 1
""")
def caption_sink(spark, folder):
    """The texts of all runs as one table, written and read back."""
    path = _folder(spark, "captions")
    cues = table(spark, folder, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("cue"), F.col("event_type").alias("cue_text"))
    writers.text_table(cues, path, "cue", "cue_text")
    return spark.read.parquet(path).select("run_id", "text")


@query("scan_pruned", "select p_name as topic from part where p_size <= 30")
def scan_pruned(spark, folder):
    return readers.table(spark, folder, "part").filter("p_size <= 30").select(F.col("p_name").alias("topic"))
