import glob
import json
import os

import pytest

from pyspark.sql import functions as F

from castwise import schemas
from castwise.plans import documentary, facts, packaging, review, timeline
from castwise.sources import readers, writers
from castwise.streaming import summaries


def test_captions(spark, tmp_path):
    rows = [(1, 0, "First line.", 3.0), (1, 1, "  ", 0.1), (1, 2, "Second line.", 2.5), (2, 0, "", 1.0)]
    cues = timeline.caption_cues(spark.createDataFrame(rows, "run_id int, idx int, narration string, duration double"), block=2)
    got = cues.orderBy("cue").collect()
    assert [(r["cue"], r["start_time"], r["end_time"], r["caption"]) for r in got] == [
        (1, "00:00:00,000", "00:00:03,000", "First line."), (2, "00:00:03,800", "00:00:06,300", "Second line.")]
    writers.caption_files(cues, str(tmp_path / "srt"), [r[0] for r in cues.select("run_id").distinct().collect()])
    body = "".join(open(p).read() for p in sorted(glob.glob(str(tmp_path / "srt/run_id=1/part-*"))))
    assert body == "1\n00:00:00,000 --> 00:00:03,000\nFirst line.\n\n2\n00:00:03,800 --> 00:00:06,300\nSecond line.\n\n"
    assert not os.path.exists(tmp_path / "srt/run_id=2")


def test_scene_plan_and_rescale(spark):
    scripts = spark.createDataFrame([(1, "T", "Short one. " + "word " * 40 + "end."), (2, "T", "")], "run_id int, title string, script string")
    scenes = timeline.scene_plan(scripts)
    got = scenes.orderBy("idx").collect()
    assert [(r["run_id"], r["duration"], r["animation"]) for r in got] == [(1, 2.5, "slow-zoom"), (1, 6.0, "pan-left")]
    same = timeline.rescale(scenes, spark.createDataFrame([(1, 9.5)], "run_id int, narration_seconds double"))
    assert sorted(r["duration"] for r in same.collect()) == [2.5, 6.0]
    longer = timeline.rescale(scenes, spark.createDataFrame([(1, 17.0)], "run_id int, narration_seconds double"))
    assert sorted(r["duration"] for r in longer.collect()) == [5.0, 12.0]


def test_documentary(spark):
    names = ["Origins", "The Turning Point", "The Consequences", "What It Means Today"]
    df = spark.createDataFrame([(1, "the fall of an empire", "One decision.", [(n, "text") for n in names])],
                               "id int, topic string, hook string, chapters array<struct<name:string,body:string>>")
    row = documentary.assemble(df, "Follow.").first()
    assert row["full_text"].count("[CHAPTER:") == 4 and "[CHAPTER: Origins]" in row["full_text"]
    assert row["structure"] == "documentary-4-chapters" and row["full_text"].startswith("[INTRODUCTION]\nOne decision.\n\nThis is the story")


def test_chapters_fall_back_to_the_arc(spark):
    rows = [("a", i, t) for i, t in enumerate(["Rome", " rome ", "wars", "lost kings", "don't stop"])] + [("b", 9, "x"), ("c", 10, "")]
    got = documentary.chapters(spark.createDataFrame(rows, "category string, id int, topic string")).collect()
    by = {c: [r["chapter"] for r in sorted(got, key=lambda r: r["chapter_no"]) if r["category"] == c] for c in "abc"}
    assert by["a"] == ["Rome", "Wars", "Lost Kings", "Don'T Stop"]
    assert by["b"] == by["c"] == ["Origins", "The Turning Point", "The Consequences", "The Hidden Pattern", "What It Means Today"]


def test_script_from_reply(spark):
    rows = [(1, "[HOOK]x[BODY] As an AI, told [ENDING]e", "My hook"), (2, "no markers", "")]
    df = spark.createDataFrame(rows, "id int, reply string, lead string")
    got = {r["id"]: r for r in documentary.script_from_reply(df, hook="lead", cta="Follow.").collect()}
    assert got[1]["full_text"] == "My hook\n\n, told\n\ne" and got[1]["word_count"] == 5 and got[1]["cta"] == "Follow."
    assert got[2]["full_text"] == "no markers" and got[2]["hook"] == ""


def test_dry_run_and_disclosure(spark):
    items = spark.createDataFrame([(1, "rome", "history", "The Fall of Rome", "About rome.", "Narrated by an AI-generated presenter.")],
                                  "id int, topic string, category string, title string, description string, disclosure string")
    items = items.withColumn("video_path", F.lit("v.mp4"))
    meta = packaging.platform_metadata(items, ["youtube", "tiktok", "radio"], carry=["video_path"])
    rows = {r["platform"]: r for r in packaging.publish_results(meta).collect()}
    assert {p: r["status"] for p, r in rows.items()} == {"youtube": "dry_run", "tiktok": "dry_run", "radio": "skipped"}
    assert all("AI-generated presenter" in r["description"] for r in rows.values())
    assert len(rows["tiktok"]["hashtags"]) == 5 and len(rows["youtube"]["hashtags"]) == 3
    manifest = packaging.publish_manifest(packaging.publish_results(meta)).first()
    assert manifest["published"] and len(manifest["packages"]) == 3
    assert manifest["packages"][0]["video_path"] == "v.mp4" and manifest["packages"][0]["privacy"] == "private"


def _bundle(root, run, **record):
    os.makedirs(root / run)
    (root / run / "review.json").write_text(json.dumps({"run_id": run, **record}, indent=2))


def test_review_round_trip(spark, tmp_path):
    _bundle(tmp_path / "review", "r1", status="approved", title="x" * 60, format="short", scorecard={"overall": 81.5}, content_id=1)
    _bundle(tmp_path / "review", "r2", status="pending", scorecard=None, content_id=2)
    _bundle(tmp_path / "review", "r3", status="approved", content_id=3)
    os.makedirs(tmp_path / "cp")
    (tmp_path / "cp" / "r1.json").write_text(json.dumps({"run_id": "r1", "category": "history", "completed_stages": ["topic"]}, indent=2))

    records = readers.review_bundles(spark, str(tmp_path / "review")).withColumnRenamed("status", "review_status")
    listed = {r["run_id"]: r for r in review.listing(records).collect()}
    assert listed["r1"]["overall"] == "81.5" and len(listed["r1"]["title"]) == 44
    assert (listed["r2"]["overall"], listed["r2"]["format"], listed["r2"]["title"]) == ("-", "-", "")
    ready = review.approved_runs(records, readers.checkpoints(spark, str(tmp_path / "cp")))
    assert [r["run_id"] for r in ready.collect()] == ["r1"]
    assert review.approved_runs(records, readers.checkpoints(spark, str(tmp_path / "cp")), "r3").count() == 0

    content = spark.createDataFrame([(1, "produced"), (2, "published"), (4, "idea")], "id long, status string")
    waiting = {r["id"]: r["status"] for r in review.mark_in_review(content, records).collect()}
    assert waiting == {1: "in_review", 2: "published", 4: "idea"}
    done = {r["id"]: r["status"] for r in review.apply_to_content(content, records).collect()}
    assert done == {1: "approved", 2: "published", 4: "idea"}


def test_append_is_replay_safe(spark, tmp_path):
    path, df = str(tmp_path / "a"), spark.range(5).withColumn("p", F.col("id") % 2)
    for batch in ("b1", "b2", "b2"):
        writers.append_batch(df, path, batch, ["p"])
    assert spark.read.parquet(path).count() == 10
    writers.insert_absent(spark.read.parquet(path), spark.range(3, 8).withColumn("p", F.lit(0)), "id", path, "b3", ["p"])
    assert spark.read.parquet(path).filter("batch_id = 'b3'").count() == 3


def test_reports_and_credits(spark, tmp_path):
    writers.single_document(spark.createDataFrame([(3, "curiosity")], "n int, prefer string"), str(tmp_path / "rules"))
    assert spark.read.json(str(tmp_path / "rules")).first().asDict() == {"n": 3, "prefer": "curiosity"}
    rows = [(1, "A", "S", "me", "cc", 0), (1, "A", "S", "", "cc", 1), (1, "B", "S", "", "pd", 2)]
    lines = packaging.credit_lines(spark.createDataFrame(rows, "run_id int, title string, source string, credit string, license string, position int"))
    writers.credit_files(lines, str(tmp_path / "credits"))
    body = "".join(open(p).read() for p in sorted(glob.glob(str(tmp_path / "credits/run_id=1/part-*"))))
    assert body == "Image credits (openly licensed):\n- A by me — S (cc)\n- B — S (pd)\n"


def test_tables_can_be_created_and_reset(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS castwise_t LOCATION '{tmp_path}/db'")
    schemas.create_tables(spark, "castwise_t")
    schemas.create_tables(spark, "castwise_t")
    assert {r["tableName"] for r in spark.sql("SHOW TABLES IN castwise_t").collect()} == set(schemas.TABLES)
    spark.sql("INSERT INTO castwise_t.ceo_reports (id, period) VALUES (1, '2024-W01')")
    schemas.create_tables(spark, "castwise_t", reset=True)
    assert spark.table("castwise_t.ceo_reports").count() == 0
    spark.sql("DROP DATABASE castwise_t CASCADE")


def test_stream_continues_where_it_stopped(spark, tmp_path):
    content = spark.createDataFrame([(1, "a"), (2, "b")], "id long, category string")
    rows = [(1, 10, 50.0), (2, 20, None), (1, 30, 60.0)]
    schema = "video_id long, views long, retention double"
    like, state = spark.createDataFrame([], schema), str(tmp_path / "state")
    results = []
    (tmp_path / "in").mkdir()
    empty = summaries.arriving(spark, str(tmp_path / "in"), like)
    assert summaries.drain(summaries.run_counts(empty.selectExpr("'a' as agent", "'s' as status")), "e", str(tmp_path / "e")).count() == 0
    for r in rows:
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = summaries.arriving(spark, str(tmp_path / "in"), like)
        live = summaries.retention_by_category(stream, content, "t", state)
        results.append({x["category"]: (x["rows"], x["total_views"], x["avg_retention"]) for x in live.collect()})
    assert results[0] == {"a": (1, 10, 50.0)}
    assert results[2] == {"a": (2, 40, 55.0), "b": (1, 20, None)}


def test_append_stream(spark, tmp_path):
    spark.range(7).write.parquet(str(tmp_path / "in"))
    stream = summaries.arriving(spark, str(tmp_path / "in"), spark.range(0))
    for _ in range(2):
        summaries.append_stream(stream, str(tmp_path / "out"), "s", str(tmp_path / "st"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7


def test_note_facts(spark):
    notes = spark.createDataFrame([(1, "- one\n\n• two\n- three\n4\n5\n6")], "id int, body string")
    got = facts.facts_from_notes(notes, "id", "body").orderBy("pos").collect()
    assert [(r["claim"], r["information_type"]) for r in got] == [
        ("one", "fact"), ("two", "event"), ("three", "person"), ("4", "stat"), ("5", "date")]


def test_allowed_license(spark):
    df = spark.createDataFrame([(x,) for x in ("", None, "CC BY 4.0", "Public Domain", "pd-old", "All rights reserved")], "l string")
    assert [r[0] for r in df.select(facts.allowed_license(F.col("l"))).collect()] == [True, True, True, True, True, False]


def test_a_status_change_leaves_no_old_row(spark, tmp_path):
    from castwise import schemas

    path, parts = str(tmp_path / "content"), list(schemas.PARTITIONS["content"])
    rows = [(1, "a", "published", "t1"), (2, "b", "in_review", "t2"), (3, "b", "in_review", None)]
    schema = "id long, category string, status string, title string"
    writers.replace_partitions(spark.createDataFrame(rows, schema), path, parts)
    changes = spark.createDataFrame([(1, "rejected", None)], "id long, status string, title string")
    for _ in range(2):  # a repeated job changes nothing more
        writers.update_rows(spark, path, changes, "id", ["status", "title"], parts)
    got = sorted((r["id"], r["category"], r["status"], r["title"]) for r in spark.read.parquet(path).collect())
    assert got == [(1, "a", "rejected", None), (2, "b", "in_review", "t2"), (3, "b", "in_review", None)]
    with pytest.raises(ValueError):
        writers.update_rows(spark, path, changes, "id", ["category"], parts)


def test_scenes_without_images_stay(spark):
    from castwise.plans import timeline

    scenes = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 0)], "run_id long, idx int")
    pools = spark.createDataFrame([(1, ["x"]), (2, [])], "run_id long, images array<string>")
    got = sorted((r["run_id"], r["idx"], r["image"]) for r in timeline.assign_images(scenes, pools).collect())
    assert got == [(1, 0, "x"), (1, 1, "x"), (2, 0, None), (3, 0, None)]


def test_row_local_timeline_equals_the_table_one(spark):
    from castwise.plans import timeline

    scripts = spark.createDataFrame([(1, "One two three. Four five! And a longer sentence to say here?", 20.0), (2, "Short one here.", None), (3, "", 5.0)],
                                    "run_id long, script string, narration_seconds double")
    rows = timeline.rescale_rows(timeline.scene_rows(scripts))
    flat = scripts.withColumn("title", F.lit("t"))
    table = timeline.rescale(timeline.scene_plan(flat).select("run_id", "idx", "narration", "duration"), scripts)
    got = sorted((r["run_id"], r["s"]["idx"], r["s"]["duration"]) for r in rows.select("run_id", F.explode("scenes").alias("s")).collect())
    assert got == sorted((r["run_id"], r["idx"], r["duration"]) for r in table.collect())
    assert sorted(map(tuple, timeline.caption_rows(rows).collect())) == sorted(map(tuple, timeline.caption_cues(table).collect()))
    plan = timeline.caption_rows(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_every_item_has_a_title(spark):
    from castwise.plans import candidates

    lines = spark.createDataFrame([(1, 1, "A good enough title"), (2, 1, "short")], "item long, position int, raw string")
    spare = spark.createDataFrame([(1, "Spare one"), (2, "Spare two"), (3, "Spare three")], "item long, title string")
    got = {r["item"]: r["title"] for r in candidates.best_titles(lines, "item", "position", "raw", fallback=spare).collect()}
    assert got == {1: "A good enough title", 2: "Spare two", 3: "Spare three"}


def test_categories_without_content_have_the_default_arc(spark):
    from castwise import params as P
    from castwise.plans import documentary

    content = spark.createDataFrame([("a", 1, "x")], "category string, id long, topic string")
    asked = spark.createDataFrame([("a",), ("empty",)], "category string")
    got = documentary.chapters(content, asked, minimum=1, maximum=4).filter("category = 'empty'").orderBy("chapter_no").collect()
    assert [r["chapter"] for r in got] == list(P.DEFAULT_ARC[:4])


def test_scratch_needs_a_shared_folder_off_one_machine():
    from castwise.session import scratch_dir

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Context:
        def getCheckpointDir(self):
            return None

    session = type("Session", (), {"conf": Conf(), "sparkContext": Context()})()
    with pytest.raises(RuntimeError):
        scratch_dir(session)


def test_staged_folders_are_emptied(spark):
    from castwise.session import clear_staged, staged, staged_folders

    keep = len(staged_folders())
    kept = staged(spark.range(5).toDF("x"), "t")
    path = staged_folders()[-1]
    assert kept.count() == 5
    assert clear_staged(spark, keep) == 1 and spark.read.parquet(path).count() == 0 and len(staged_folders()) == keep


def test_derived_chapters_lead_the_script(spark):
    from castwise.plans import documentary

    items = spark.createDataFrame([(1, "a", "T", "H"), (2, "a", "U", None), (3, None, "V", "")], "id long, category string, topic string, hook string")
    names = spark.createDataFrame([("a", 1, "Second"), ("a", 0, "First"), ("b", 0, "Other")], "category string, chapter_no int, chapter string")
    bodies = spark.createDataFrame([(1, 0, "one."), (1, 1, None), (2, 1, "two."), (2, 7, "lost."), (9, 0, "nobody's.")], "id long, chapter_no int, body string")
    got = {r["id"]: r for r in documentary.scripts(items, names, bodies, "Follow.").collect()}
    assert got[1]["body"] == "[CHAPTER: First]\none.\n\n[CHAPTER: Second]\n"
    assert got[2]["body"] == "[CHAPTER: First]\n\n\n[CHAPTER: Second]\ntwo."
    assert (got[1]["structure"], got[3]["structure"], got[3]["body"]) == ("documentary-2-chapters", "documentary-0-chapters", "")
    assert got[1]["full_text"].startswith("[INTRODUCTION]\nH\n\n") and got[3]["full_text"].endswith("[CTA]\nFollow.")
    assert documentary.scripts(items, names.limit(0), bodies, "Follow.").count() == 3


def test_documents_work_their_rows_out_once(spark, tmp_path):
    """Counting the rows and finding their ranges does not compute them again; one file holds one row, in the order of the key."""
    seen = spark.sparkContext.accumulator(0)

    def passed(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    rows = spark.range(1203).selectExpr("lpad(1202 - id, 5, '0') as run", "concat('v', lpad(1202 - id, 5, '0')) as value")
    writers.documents(rows.mapInPandas(passed, "run string, value string"), f"{tmp_path}/out", "run")
    assert seen.value == 1203
    files = sorted(tmp_path.glob("out/part-*"))
    assert [f.read_text().strip() for f in files] == [f"v{i:05d}" for i in range(1203)]
