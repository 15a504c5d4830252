import pytest
from pyspark.sql import functions as F

from castwise import schemas
from castwise.operators import rollups
from castwise.streaming import ingest, summaries


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def test_documents_land_once(spark, tmp_path, folder):
    (tmp_path / "in").mkdir()
    put = lambda name, text: (tmp_path / "in" / name).write_text(text)
    put("a.json", '{"run_id": "a", "title": "A\\nB"}')
    put("b.json", "{broken")
    assert ingest.land_documents(spark, f"{folder}/in", f"{folder}/out", schemas.REVIEW_RECORD) == 2
    before = sorted(p.name for p in (tmp_path / "out" / "rows").rglob("part-*.parquet"))
    put("c.json", '{"run_id": "c"}')
    put("a.json", '{"run_id": "changed"}')  # a file that was read is not read again
    assert ingest.land_documents(spark, f"{folder}/in", f"{folder}/out", schemas.REVIEW_RECORD) == 1
    assert ingest.land_documents(spark, f"{folder}/in", f"{folder}/out", schemas.REVIEW_RECORD) == 0
    got = sorted((r["path"].rsplit("/", 1)[1], r["run_id"], r["title"], r["bad_record"]) for r in ingest.landed(spark, f"{folder}/out").collect())
    assert got == [("a.json", "a", "A\nB", None), ("b.json", None, None, "{broken"), ("c.json", "c", None, None)]
    assert set(before) <= {p.name for p in (tmp_path / "out" / "rows").rglob("part-*.parquet")}


def _rows(path):
    return sorted(p.name for p in path.glob("*"))


def test_a_trigger_writes_the_keys_it_changed(spark, tmp_path, folder):
    schema = "video_id long, views long, retention double"
    like = spark.createDataFrame([], schema)
    (tmp_path / "in").mkdir()
    batches = [[(i, 10, 50.0) for i in range(100)], [(1, 5, None), (2, 5, 10.0)], [(1, 1, 1.0)], [(200, 7, 7.0)], [(1, 2, 2.0)]]
    state = f"{folder}/state"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        sums = summaries.per_video(summaries.arriving(spark, f"{folder}/in", like))
        summaries.keyed_stream(sums, state, fold_after=3)  # every call is a restart
    everything = spark.createDataFrame([r for b in batches for r in b], schema)
    want = sorted(map(tuple, summaries.per_video(everything).collect()))
    assert sorted(map(tuple, summaries.current(spark, state, sums.schema).collect())) == want
    written = {r["batch"]: r["count"] for r in spark.read.schema(sums.schema).option("basePath", f"{state}/changed").parquet(f"{state}/changed").groupBy("batch").count().collect()}
    assert written == {3: 1, 4: 1}  # the first three are folded
    folded = spark.read.schema(sums.schema).parquet(f"{state}/folded")
    assert folded.count() == 100
    # nothing new: nothing is written
    summaries.keyed_stream(summaries.per_video(summaries.arriving(spark, f"{folder}/in", like)), state, fold_after=3)
    assert sorted(map(tuple, summaries.current(spark, state, sums.schema).collect())) == want


def test_a_replayed_batch_changes_nothing(spark, folder):
    schema = summaries.per_video(spark.createDataFrame([], "video_id long, views long, retention double")).schema
    row = lambda v, n: spark.createDataFrame([(v, n)], "video_id long, n long").select(
        "video_id", F.col("n").alias("rows"), F.col("n").cast("decimal(38,0)").alias("views"), F.lit(None).cast("decimal(28,4)").alias("retention"), F.lit(0).cast("long").alias("rated"))
    for batch, (v, n) in ((0, (1, 1)), (1, (1, 2)), (1, (1, 2))):
        row(v, n).write.mode("overwrite").parquet(f"{folder}/changed/batch={batch}")
    assert [(r["video_id"], r["rows"]) for r in summaries.current(spark, folder, schema).select("video_id", "rows").collect()] == [(1, 2)]


def test_a_replaced_batch_is_taken_out(spark, tmp_path, folder):
    schema = "video_id long, views long, retention double"
    make = lambda rows: spark.createDataFrame(rows, schema)
    first, second, smaller = [(1, 10, 50.0), (2, 20, None)], [(1, 5, 40.0), (3, 9, 1.0)], [(3, 1, 2.0)]
    path = f"{folder}/parts"
    rollups.store_batch(make(first), path, "a")
    rollups.store_batch(make(second), path, "b")
    rollups.store_batch(make(smaller), path, "b")
    rollups.store_batch(make(smaller), path, "b")
    want = sorted(map(tuple, rollups.parts(make(first + smaller)).select("video_id", "rows", F.col("views").cast("bigint"), "retention", "rated").collect()))
    got = rollups.totals(spark, path)
    assert sorted(map(tuple, got.collect())) == want
    assert "parts" in got._jdf.queryExecution().executedPlan().toString()
    assert {r["video_id"] for r in rollups.totals(spark, path, make(smaller)).collect()} == {3}
