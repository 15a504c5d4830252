import numpy as np
import pytest

from castwise.llm import mixing
from tests.llm.conftest import prose


def members(spark, p, n):
    return spark.createDataFrame([(int(k), [float(v) for v in row]) for k, row in zip(n, p)], "n_tokens bigint, p array<double>")


def test_rates_meet_feasible_targets(spark):
    r = np.random.default_rng(3)
    p = r.dirichlet([0.3, 0.3, 0.3], 600)
    n = r.integers(1, 900, 600)
    table = members(spark, p, n)
    for targets in ({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.2, "b": 0.2, "c": 0.6}):
        rates = mixing.fit_rates(table, ["a", "b", "c"], targets, steps=200).of(p)
        mass = (n * rates) @ p / n.sum()
        assert rates.min() >= 0 and np.abs(mass - list(targets.values())).max() < 1e-3


def test_infeasible_targets_come_as_near_as_they_can(spark):
    """All documents alike: the best rates scale them by one number."""
    p, n = np.tile([0.5, 0.5], (50, 1)), np.full(50, 10)
    rates = mixing.fit_rates(members(spark, p, n), ["a", "b"], {"a": 1.0, "b": 0.0}, steps=200).of(p)
    assert np.allclose(rates, 1.0, atol=1e-3)


def test_anchor_keeps_its_tokens(spark):
    p = np.array([[1.0, 0.0]] * 30 + [[0.0, 1.0]] * 10)
    n = np.full(40, 100)
    rates = mixing.fit_rates(members(spark, p, n), ["a", "b"], {"a": 0.9, "b": 0.1}, anchor="a", steps=300).of(p)
    assert np.allclose(rates[:30], 1.0, atol=0.01) and np.allclose(rates[30:], 1 / 3, atol=0.01)


def test_bad_targets(spark):
    with pytest.raises(ValueError):
        mixing.fit_rates(members(spark, np.ones((1, 1)), [1]), ["a"], {"a": -1.0})


def test_copies_follow_rates(spark):
    from pyspark.sql import functions as F

    got = spark.range(20_000).select(mixing.copies(F.lit(1.3), F.col("id")).alias("c"), mixing.copies(F.lit(0.98), F.col("id")).alias("one"))
    row = got.selectExpr("avg(c) as c", "min(c) as low", "max(c) as high", "min(one) as one").first()
    assert abs(row["c"] - 1.3) < 0.02 and (row["low"], row["high"], row["one"]) == (1, 2, 1)


def test_posteriors_on_held_out(spark):
    """Classifier of a quarter of the labels, judged on the others."""
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = mixing.labelled_domains(spark.read.parquet(f"{folder}/labels.parquet")).filter("domain is not null")
    from castwise.llm.common import Stage

    seen = labels.filter("doc_id % 4 <> 0")
    model = mixing.train(docs, seen, ["clean", "low", "toxic"], Stage(spark, "test"))
    asked = docs.join(labels.filter("doc_id % 4 = 0"), "doc_id")
    rows = mixing.posteriors(asked, model, ["domain"]).collect()
    right = [model.domains[int(np.argmax(r["p"]))] == r["domain"] for r in rows]
    assert np.mean(right) > 0.93


def test_edges(spark, frame, edges):
    labelled = spark.createDataFrame([(4, "clean"), (6, "toxic"), (6, "low"), (7, None), (None, "clean"), (8, "other")], "doc_id bigint, domain string")
    got = mixing.mixture(frame(edges), labelled).collect()
    assert len(got) == len(edges) and all(r["rate"] >= 0 and r["copies"] >= 0 for r in got)
    assert all(abs(r["p_clean"] + r["p_low"] + r["p_toxic"] - 1) < 1e-6 for r in got)
    assert mixing.mixed(frame(edges), labelled).columns == frame(edges).columns
    none = labelled.limit(0)
    assert mixing.mixture(frame(edges), none).count() == len(edges)
    assert mixing.mixture(frame([]), none).count() == 0 and mixing.mixed(frame([]), labelled).count() == 0


def test_rows_are_repeated_by_rate(spark, frame):
    docs = frame([(i, prose(i, 50)) for i in range(40)])
    labelled = spark.createDataFrame([(i, "clean") for i in range(40)], "doc_id bigint, domain string")
    told = {r["doc_id"]: r["copies"] for r in mixing.mixture(docs, labelled).collect()}
    out = {}
    for r in mixing.mixed(docs, labelled).collect():
        out[r["doc_id"]] = out.get(r["doc_id"], 0) + 1
    assert out == {i: c for i, c in told.items() if c}
