import random
import re

import pytest
from pyspark.sql import functions as F

from castwise import schemas
from castwise.operators import corpus_index, sets
from castwise.plans import performance
from castwise.session import staged_folders


def _shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i:i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())


def _texts(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(150)]
    base = [[r.choice(words) for _ in range(r.randint(1, 60))] for _ in range(12)]
    out = []
    for _ in range(n):
        t = list(r.choice(base))
        for _ in range(r.randint(0, 4)):
            t[r.randrange(len(t))] = r.choice(words)
        out.append(" ".join(t))
    return out + ["", None, "one", "two words"]


def _frame(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t) for i, t in enumerate(texts)], "doc_id long, text string")


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


@pytest.mark.parametrize("threshold", [0.8, 0.3])
def test_two_batches_give_the_result_of_one(spark, folder, threshold):
    a, b, new = _texts(1, 50), _texts(2, 50), _texts(3, 60)
    two = corpus_index.create(_frame(spark, a), f"two{int(threshold * 10)}", f"{folder}/two", threshold)
    assert corpus_index.publish(_frame(spark, a), two) > 0
    corpus_index.publish(_frame(spark, b), two)
    got = {r["doc_id"]: r for r in corpus_index.probe(_frame(spark, new), two).collect()}
    sets = [_shingles(t) for t in a + b]
    assert len(got) == len(new)
    for i, t in enumerate(new):
        s = _shingles(t)
        best = max((len(s & o) / len(s | o) for o in sets if s and o), default=0.0)
        assert got[i]["max_similarity"] == pytest.approx(best if best >= threshold else 0.0), t
        assert got[i]["is_duplicate"] == (best >= threshold)
    # a batch that is published again adds nothing
    assert corpus_index.publish(_frame(spark, b, 1000), two) == 0
    assert two.table("sets").count() == two.table("sets").select("node").distinct().count()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _index_sides(plan, table):
    """For every scan of ``table``: the operators above it up to the join it feeds."""
    lines = plan.splitlines()
    out = []
    for i, line in enumerate(lines):
        if "FileScan" in line and table in line:
            depth, above = len(re.match(r"[\s:+\-|*]*", line).group()), []
            for up in reversed(lines[:i]):
                d = len(re.match(r"[\s:+\-|*]*", up).group())
                if d < depth:
                    depth = d
                    above.append(up.strip())
                    if "Join" in up:
                        break
            out.append(above)
    return out


def test_a_batch_shuffles_no_index_and_reads_no_old_text(spark, folder):
    old = _frame(spark, _texts(4, 40))
    index = corpus_index.create(old, "planned", f"{folder}/planned")
    corpus_index.publish(old, index)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _plan(corpus_index.candidates(corpus_index.prefixes(corpus_index._sets(_frame(spark, _texts(5, 5)), index), index), index))
        for part in ("order", "postings"):
            sides = _index_sides(plan, f"planned_{part}")
            assert sides and all("Join" in s[-1] and not any("Exchange" in x for x in s) for s in sides), plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_bucketed_tables_join_without_exchange(spark, folder):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS bucket_t LOCATION '{folder}/bucket_t'")
    schemas.create_tables(spark, "bucket_t", reset=True)
    ids = spark.range(200)
    schemas.append_rows(ids.select("id", F.concat(F.lit("c"), F.col("id") % 3).alias("category"), F.lit("published").alias("status")), "content", "bucket_t")
    schemas.append_rows(ids.select((F.col("id") % 50).alias("video_id"), F.lit("p").alias("platform"), F.lit(2).alias("views"), F.lit(5.0).alias("retention")), "analytics", "bucket_t")
    schemas.append_rows(ids.filter("id < 80").select(F.col("id").alias("video_id"), F.lit("h").alias("hook_type")), "content_memory", "bucket_t")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = performance.stored_performance(*(spark.table(f"bucket_t.{t}") for t in ("content", "analytics", "content_memory")))
        assert "Exchange" not in _plan(joined) and "SortMergeJoin" in _plan(joined)
        rows = joined.collect()
        assert len(rows) == 80 and sum(r["views"] or 0 for r in rows) == 400
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        schemas.create_tables(spark, "bucket_t", reset=True)


def test_only_texts_that_share_enough_are_compared(spark, folder):
    """Long texts that share a line or two are counted out; pairs at the threshold stay."""
    r = random.Random(9)
    own = lambda n: " ".join(f"u{r.randrange(10**9)}" for _ in range(n))
    old = [f"one two three four {own(90)}" for _ in range(40)]
    new = [f"one two three four {own(90)}" for _ in range(10)] + [" ".join(old[3].split()[:60]) + " " + own(30)]
    index = corpus_index.create(_frame(spark, [own(20)]), "counted", f"{folder}/counted", 0.15)
    corpus_index.publish(_frame(spark, old), index)
    sets = corpus_index._sets(_frame(spark, new), index)
    assert corpus_index.candidates(corpus_index.prefixes(sets, index), index).count() == 1
    got = {x["doc_id"]: x["max_similarity"] for x in corpus_index.probe(_frame(spark, new), index).collect()}
    assert got[10] > 0.4 and sum(v > 0 for v in got.values()) == 1


def test_a_batch_is_compared_in_pieces(spark, folder, monkeypatch):
    """Pieces of a batch, equal texts among them, find the closest of all published ones; nothing of a published batch stays staged."""
    monkeypatch.setattr(sets, "HELD", 150)
    old, new = _texts(11, 60), _texts(12, 50)
    new += [old[0], old[0], new[1]]
    before = staged_folders()
    index = corpus_index.create(_frame(spark, old), "pieces", f"{folder}/pieces", 0.3)
    corpus_index.publish(_frame(spark, old), index)
    assert staged_folders() == before
    found = corpus_index.probe(_frame(spark, new), index)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "tokens" not in plan and "sh#" not in plan, plan
    got = {r["doc_id"]: r["max_similarity"] for r in found.collect()}
    every = [_shingles(t) for t in old]
    for i, t in enumerate(new):
        best = max((len(_shingles(t) & o) / len(_shingles(t) | o) for o in every if o and t), default=0.0)
        assert got[i] == pytest.approx(best if best >= 0.3 else 0.0), t
