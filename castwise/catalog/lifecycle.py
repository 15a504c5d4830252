"""Write-backs along an item's life: produced, scheduled, published, measured."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from castwise import schemas
from castwise.catalog.base import ORACLES, QUERIES, query, table, view
from castwise.operators import rollups
from castwise.operators.joins import for_each
from castwise.operators.sequences import positions
from castwise.plans import audit, packaging, performance, review
from castwise.session import scratch_dir, staged
from castwise.sources import filesets, readers, writers
from castwise.streaming import ingest

# review records of the produced content, and publishing results of every third run
_RECORDS = """
    select 'run-' || id as run_id, id as content_id, case when id % 4 = 0 then 'approved' else 'pending' end as review_status,
           cast(null as varchar) as published_at, cast(null as varchar) as scheduled_date from content_v where status <> 'quality_failed'
"""


def _records(spark, folder):
    none = F.lit(None).cast("string")
    return view(spark, folder, "content_v").filter("status <> 'quality_failed'").select(
        F.concat(F.lit("run-"), F.col("id").cast("string")).alias("run_id"), F.col("id").alias("content_id"),
        F.when(F.col("id") % 4 == 0, "approved").otherwise("pending").alias("review_status"),
        none.alias("published_at"), none.alias("scheduled_date"))


def _results(spark, folder):
    """A result per run and platform: orders stand for attempts."""
    return table(spark, folder, "orders").select(
        F.concat(F.lit("run-"), F.col("o_custkey").cast("string")).alias("run_id"), F.col("o_orderpriority").alias("platform"),
        F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") == "P", "dry_run").otherwise("failed").alias("status"))


_PUBLISHED = f"""
    with rec as ({_RECORDS}),
    done as (select distinct 'run-' || o_custkey as run_id from orders where o_orderstatus in ('F', 'P')),
    pub as (select rec.run_id, content_id, case when done.run_id is not null then 'published' else review_status end as review_status,
              case when done.run_id is not null then '2024-02-01' end as published_at from rec left join done using (run_id))
"""


@query("publish_records", _PUBLISHED + "select * from pub", ["content_v"])
def publish_records(spark, folder):
    rows = review.publish(_records(spark, folder), _results(spark, folder), F.lit("2024-02-01"))
    return rows.drop("scheduled_date")


@query("publish_content", _PUBLISHED + """,
    d as (select content_id as id, min(published_at) as first_at from pub where review_status = 'published' group by 1)
    select c.id, case when d.id is not null then 'published' else status end as status, first_at as published_date from content_v c left join d using (id)
""", ["content_v"])
def publish_content(spark, folder):
    records = review.publish(_records(spark, folder), _results(spark, folder), F.lit("2024-02-01"))
    content = view(spark, folder, "content_v").select("id", "status", F.lit(None).cast("string").alias("published_date"))
    return review.publish_content(content, records)


@query("schedule_records", f"""
    with rec as ({_RECORDS}),
    n as (select run_id, row_number() over (order by run_id) as k from rec where review_status = 'pending')
    select rec.run_id, review_status, case when k <= 25 then strftime(date '2024-03-01' + (k * 2)::int, '%Y-%m-%d') end as scheduled_date
    from rec left join n using (run_id)
""", ["content_v"])
def schedule_records(spark, folder):
    """A batch of 25 slots, every second day."""
    slots = spark.range(1, 26).select(
        F.col("id").alias("batch_position"), F.date_add(F.lit("2024-03-01").cast("date"), (F.col("id") * 2).cast("int")).cast("string").alias("date"))
    return review.schedule(_records(spark, folder), slots).select("run_id", "review_status", "scheduled_date")


_PRODUCED = """
    select id as content_id, topic, title as hook, case id % 2 when 0 then 'curiosity' else 'emotion' end as hook_type,
           video_format as story_structure, category as script_style, cast(quality_score as double) as duration from content_v where status = 'published'
"""


def _produced(spark, folder):
    return view(spark, folder, "content_v").filter("status = 'published'").select(
        F.col("id").alias("content_id"), "topic", F.col("title").alias("hook"),
        F.when(F.col("id") % 2 == 0, "curiosity").otherwise("emotion").alias("hook_type"),
        F.col("video_format").alias("story_structure"), F.col("category").alias("script_style"), F.col("quality_score").cast("double").alias("duration"))


@query("finalize_memory", f"""
    select content_id as video_id, topic, hook, hook_type, story_structure, script_style, duration
    from ({_PRODUCED}) where content_id not in (select o_custkey from orders)
""", ["content_v"])
def finalize_memory(spark, folder):
    """Orders stand for memory rows: the videos of all others are remembered now."""
    memory = table(spark, folder, "orders").select(F.col("o_custkey").alias("video_id"))
    return review.finalize(_produced(spark, folder), memory)


@query("topics_used", f"""
    select topic_id, case when case when coalesce(angle, '') = '' then topic else angle end in (select topic from ({_PRODUCED})) then 'used' else status end as status
    from topics_v
""", ["content_v", "topics_v"])
def topics_used(spark, folder):
    return review.mark_used(view(spark, folder, "topics_v"), _produced(spark, folder)).select("topic_id", "status")


@query("score_memory", """
    with m as (select o_orderkey as id, o_custkey as video_id, o_totalprice as performance_score from orders),
    f as (select video_id, min(id) as id from m group by 1),
    a as (select video_id, round(sum(cast(retention as decimal(18, 4)))::double / count(retention), 1) as s from analytics_v group by 1)
    select m.id, m.video_id, case when f.id = m.id and s is not null then s else performance_score end as performance_score
    from m left join f using (video_id) left join a using (video_id)
""", ["analytics_v"])
def score_memory(spark, folder):
    """Orders stand for memory rows: only the first one of a video takes its measured retention."""
    memory = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("video_id"), F.col("o_totalprice").alias("performance_score"))
    return performance.score_memory(memory, view(spark, folder, "analytics_v"))


def _folder(spark, label: str) -> str:
    return f"{scratch_dir(spark)}/castwise/{label}-{uuid.uuid4().hex}"


@query("status_update", """
    with ch as (select distinct l_partkey as id from lineitem where l_quantity > 40)
    select id, category, case when ch.id is not null then 'rejected' else status end as status,
           case when ch.id is not null then cast(null as varchar) else title end as title
    from content_v left join ch using (id)
""", ["content_v"])
def status_update(spark, folder):
    """Content on its declared layout: statuses change, titles are set to NULL, and no row is left behind."""
    path, parts = _folder(spark, "status"), list(schemas.PARTITIONS["content"])
    content = view(spark, folder, "content_v").select("id", "status", "title", "category")
    writers.replace_partitions(content, path, parts)
    changes = table(spark, folder, "lineitem").filter("l_quantity > 40").select(F.col("l_partkey").alias("id")).distinct().select(
        "id", F.lit("rejected").alias("status"), F.lit(None).cast("string").alias("title"))
    writers.update_rows(spark, path, changes, "id", ["status", "title"], parts)
    return spark.read.parquet(path).select("id", "category", "status", "title")


@query("status_move", """
    with ch as (select distinct l_partkey as id from lineitem where l_quantity > 40 and l_returnflag = 'R')
    select id, category, case when ch.id is not null then 'rejected' else status end as status,
           case when ch.id is not null then cast(null as varchar) else title end as title
    from content_v left join ch using (id)
""", ["content_v"])
def status_move(spark, folder):
    """Content partitioned by status: changed rows move to another partition, in a new list of files."""
    path = _folder(spark, "moves")
    filesets.create(view(spark, folder, "content_v").select("id", "category", "status", "title"), path, ["status"])
    changes = table(spark, folder, "lineitem").filter("l_quantity > 40 and l_returnflag = 'R'").select(
        F.col("l_partkey").alias("id")).distinct().select("id", F.lit("rejected").alias("status"), F.lit(None).cast("string").alias("title"))
    filesets.update(spark, path, changes, "id", ["status", "title"])
    return filesets.read(spark, path)


@query("review_scan", """
    with r as (select s_suppkey as id, 'run-' || lpad(s_suppkey::varchar, 9, '0') as run_id, s_name as title, 'approved' as status from supplier),
    c as (select l_suppkey as id, count(distinct l_returnflag) as n from lineitem group by 1)
    select run_id, title, status, c.n as stages, row_number() over (order by run_id) as position from r left join c using (id)
""")
def review_scan(spark, folder):
    """Review bundles as one JSON document per run, with their checkpoints, in path order. Suppliers stand for runs."""
    root = _folder(spark, "review")
    run = lambda c: F.concat(F.lit("run-"), F.lpad(F.col(c).cast("string"), 9, "0"))
    records = table(spark, folder, "supplier").select(run("s_suppkey").alias("run"), F.to_json(F.struct(
        run("s_suppkey").alias("run_id"), F.lit("approved").alias("status"), F.col("s_name").alias("title"))).alias("value"))
    writers.documents(records, f"{root}/bundles", "run")
    stages = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.collect_set("l_returnflag").alias("s"))
    marks = stages.select(run("l_suppkey").alias("run"), F.to_json(F.struct(
        run("l_suppkey").alias("run_id"), F.col("s").alias("completed_stages"))).alias("value"))
    writers.documents(marks, f"{root}/checkpoints", "run")
    bundles = readers.json_documents(spark, f"{root}/bundles", schemas.REVIEW_RECORD)
    points = readers.json_documents(spark, f"{root}/checkpoints", schemas.CHECKPOINT)
    joined = bundles.join(points.select("run_id", F.size("completed_stages").cast("long").alias("stages")), "run_id", "left")
    rows = staged(joined.select("run_id", "title", "status", "stages", "path", F.lit(0).alias("__all")), "review")  # files are read once
    return positions(rows, ["__all"], [F.col("path")]).select("run_id", "title", "status", "stages", "position")


@query("review_ingest", """
    select case when s_acctbal < 0 then null else 'run-' || lpad(s_suppkey::varchar, 9, '0') end as run_id,
           case when s_acctbal < 0 then null else s_name end as title, case when s_acctbal < 0 then 'broken ' || s_name end as bad_record from supplier
""")
def review_ingest(spark, folder):
    """Bundles landed as they come: those of the first nations, then only the others. Documents that are no JSON stay as text."""
    root = _folder(spark, "ingest")
    run = F.concat(F.lit("run-"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"))
    document = F.when(F.col("s_acctbal") < 0, F.concat(F.lit("broken "), "s_name")).otherwise(
        F.to_json(F.struct(run.alias("run_id"), F.lit("approved").alias("status"), F.col("s_name").alias("title"))))
    records = table(spark, folder, "supplier").select(run.alias("run"), "s_nationkey", document.alias("value"))
    for name, some in (("first", records.filter("s_nationkey < 12")), ("rest", records.filter("s_nationkey >= 12"))):
        writers.documents(some, f"{root}/in/{name}", "run", "value")
        ingest.land_documents(spark, f"{root}/in/*", f"{root}/landed", schemas.REVIEW_RECORD)
    return ingest.landed(spark, f"{root}/landed").select("run_id", "title", "bad_record")


@query("rollup_replaced", """
    with a as (select * from analytics_v where platform <> 'R' or views > 10),
    s as (select video_id, count(*) as rows, sum(views) as views, sum(cast(retention as decimal(18, 4))) as retention, count(retention) as rated from a group by 1)
    select category, sum(rows)::bigint as rows, sum(views)::bigint as views, round(sum(retention)::double / sum(rated)::double, 1) as avg_retention
    from s join content_v on id = video_id group by 1
""", ["analytics_v", "content_v"])
def rollup_replaced(spark, folder):
    """Analytics of every platform as a batch of its own; one batch comes again, smaller, and takes its first version out."""
    path, analytics = _folder(spark, "rollup"), view(spark, folder, "analytics_v")
    for platform in ("A", "N", "R"):
        rollups.store_batch(analytics.filter(F.col("platform") == platform), path, platform)
    rollups.store_batch(analytics.filter("platform = 'R' and views > 10"), path, "R")
    return rollups.by_category(rollups.totals(spark, path), view(spark, folder, "content_v"))


@query("stored_performance", """
    with a as (select video_id, sum(views)::bigint as views, round(sum(cast(retention as decimal(18, 4)))::double / count(retention), 1) as retention
               from analytics_v group by 1)
    select c.id, category, status, views, retention, hook_type, performance_score::double as performance_score
    from content_v c left join a on a.video_id = c.id join memory_v m on m.video_id = c.id
""", ["content_v", "analytics_v", "memory_v"])
def stored_performance(spark, folder):
    """Content, analytics and memory created, stored in buckets of the video, and joined there."""
    database = f"castwise_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{_folder(spark, 'tables')}'")
    schemas.create_tables(spark, database)
    schemas.append_rows(view(spark, folder, "content_v"), "content", database)
    schemas.append_rows(view(spark, folder, "analytics_v"), "analytics", database)
    schemas.append_rows(view(spark, folder, "memory_v"), "content_memory", database)
    return performance.stored_performance(*(spark.table(f"{database}.{t}") for t in ("content", "analytics", "content_memory")))


@query("status_missing", """
    select status from (values ('published'), ('in_review'), ('quality_failed'), ('approved'), ('rejected')) t(status)
    where status not in (select status from content_v)
""", ["content_v"])
def status_missing(spark, folder):
    """Expected statuses that no content has."""
    expected = spark.createDataFrame([(s,) for s in ("published", "in_review", "quality_failed", "approved", "rejected")], "status string")
    return audit.missing(expected, view(spark, folder, "content_v"), "status")


@query("manifest_sink", """
    select c.id, p.platform, c.topic || '!' as title, case when p.platform = 'fax' then 'skipped' else 'dry_run' end as status,
           'private' as privacy, '2024-02-01 00:00:00' as generated_at, true as dry_run
    from content_v c, (values ('youtube'), ('tiktok'), ('fax')) p(platform)
""", ["content_v"])
def manifest_sink(spark, folder):
    """Manifests of all items as JSON lines, read back: packages beside their results."""
    path = _folder(spark, "manifest")
    content = view(spark, folder, "content_v")
    none = F.lit(None).cast("string")
    packages = for_each(content, ["youtube", "tiktok", "fax"], "platform").select(
        "id", "platform", F.concat("topic", F.lit("!")).alias("title"), none.alias("description"), none.alias("tags"), none.alias("hashtags"), "category")
    results = packaging.publish_results(packages)
    manifest = packaging.publish_manifest(results, generated_at=F.lit("2024-02-01 00:00:00"))
    writers.json_report(manifest, path)
    stored = spark.read.schema(manifest.schema).json(path)
    pairs = stored.select("id", "generated_at", "dry_run", F.explode(F.arrays_zip("packages", "results")).alias("z"))
    return pairs.select("id", F.col("z.packages.platform").alias("platform"), F.col("z.packages.title").alias("title"),
                        F.col("z.results.status").alias("status"), F.col("z.packages.privacy").alias("privacy"), "generated_at", "dry_run")


@query("rules_sink", ORACLES["learned_rules"])
def rules_sink(spark, folder):
    """The learned rules written as one document and read back."""
    path = _folder(spark, "rules")
    rules = QUERIES["learned_rules"](spark, folder)
    writers.single_document(rules, path)
    return spark.read.schema(rules.schema).json(path)


@query("credit_sink", f"""
    select run_id, string_agg(line, chr(10) order by position, line) as text from ({ORACLES['credit_lines']}) group by 1
""")
def credit_sink(spark, folder):
    """Every run's credits as one text in the text table."""
    path = _folder(spark, "credits")
    lines = QUERIES["credit_lines"](spark, folder).withColumn("place", F.struct("position", "line"))
    writers.text_table(lines, path, "place", "line")
    return spark.read.parquet(path).select("run_id", "text")
