
import pytest

import corpus_pipeline
from castwise.llm import quality
from castwise.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_queries():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0 or name == "op2_passages"


def test_stages_are_judged_on_their_own_input(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, FOLDER).cache()
        seen.append((name, before.count(), after.count()))
        if name != "packing":
            assert sorted(after.columns) == sorted(docs.columns)
            assert {f.name: f.dataType for f in after.schema} == {f.name: f.dataType for f in docs.schema}
        before = after
    assert [n for n, _, _ in seen] == ["quality classifier", "simhash near-dedup", "suffix-array dedup", "mixing", "packing"]
    assert seen[0][1] > seen[0][2] and seen[1][1] > seen[1][2]


def test_stages_against_brute_force(spark):
    """Every stage's rows on its own input, by slower means where there are any."""
    from tests.llm.test_simhash import slow_components, slow_print
    from tests.llm.test_suffix import slow

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("n_chars < 4000")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = quality.train(docs, labels)
    one = quality.accepted(docs, labels).cache()
    assert sorted(r[0] for r in one.select("doc_id").collect()) == sorted(
        r["doc_id"] for r in quality.scored(docs, model).collect() if r["score"] >= 0.7)
    two = corpus_pipeline.near_dedup(spark, one, FOLDER).cache()
    of = slow_components([(r["doc_id"], slow_print(r["text"])) for r in one.collect()])
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(set(of.values()))
    three = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.substring_dedup(spark, two, FOLDER).collect()}
    for i, b, gone in slow([(r["doc_id"], r["text"]) for r in two.collect()], 50):
        kept = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
        assert three.get(i, ("", 0)) == ((kept, len(kept)) if kept.strip() else ("", 0))


def test_run_is_the_stages_in_turn(spark):
    rows = corpus_pipeline.run(spark, FOLDER).select("doc_id", "start", "length", "ids_crc32").collect()
    again = corpus_pipeline.run(spark, FOLDER).select("doc_id", "start", "length", "ids_crc32").collect()
    assert rows and sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "pages", "embeddings"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name, fn in QUERIES.items():
        assert fn(spark, str(tmp_path)).count() == 0, name
