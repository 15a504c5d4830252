import zlib

import numpy as np

from castwise.llm import quality
from tests.llm.conftest import prose

FOLDER = "/root/testdata/sf0.01"


def test_statistics_are_finite():
    for text in (b"", b" ", b"\n\n", b"a", b"\xff\xfe", prose(1, 50_000).encode(), b"x" * 100_000, b"AB " * 500):
        row = quality.statistics(text)
        assert len(row) == len(quality.FEATURES) and np.isfinite(row).all()


def test_trees_learn_and_traverse_alike():
    r = np.random.default_rng(1)
    x = r.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] < -0.2)).astype(float)
    model = quality.fit(x, y, trees=40)
    assert ((model.score(x) > 0.5) == y).mean() > 0.97
    inner = model.feature.shape[1]
    for i in range(0, 2000, 97):
        total = model.base
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf):
            node = 0
            while node < inner:
                node = 2 * node + 1 + int(x[i, f[node]] > t[node])
            total += leaf[node - inner]
        assert abs(1 / (1 + np.exp(-total)) - model.score(x[i: i + 1])[0]) < 1e-9


def test_one_class_and_none():
    x = np.zeros((4, 2))
    assert quality.fit(x, np.ones(4)).score(x).min() > 0.99
    assert quality.fit(x, np.zeros(4)).score(x).max() < 0.01
    assert quality.fit(x[:0], np.zeros(0)).score(x).min() > 0.99


def test_held_out_accuracy_and_no_leak(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    taken = [r["doc_id"] for r in quality.labelled(docs, labels).collect()]
    assert taken and all(zlib.crc32(str(i).encode()) % 4 != 2 for i in taken)
    got = quality.op7_quality(
        spark, FOLDER).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.95
    assert {r["doc_id"] for r in got}.isdisjoint(taken)


def test_edges(spark, frame, edges):
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 1), (7, None), (None, 1), (8, 0), (9, 1), (10, 0), (99, 1)], "doc_id bigint, quality int")
    model = quality.train(frame(edges), labels)
    got = quality.scored(frame(edges), model, name="s").collect()
    assert len(got) == len(edges) and all(0 <= r["s"] <= 1 for r in got)
    assert quality.accepted(frame(edges), labels).columns == frame(edges).columns
    assert quality.accepted(frame([]), labels.limit(0)).count() == 0
    assert quality.accepted(frame(edges), labels.limit(0)).count() == len(edges)


def test_sample_is_bounded(spark, frame):
    docs = frame([(i, prose(i, 20)) for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int")
    assert 0 < quality.labelled(docs, labels, sample_rows=7).count() <= 7
