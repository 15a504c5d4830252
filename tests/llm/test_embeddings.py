import os

import numpy as np
import pytest

from castwise.llm import embeddings

SCHEMA = "vec_id bigint, embedding array<float>, label int, node int, shard string, row int, first int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, c, 1, "s", 2, 3) for i, v, c in rows], SCHEMA)


def balls(seed=5, n=300, size=40, width=16):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        rows.append((i, r.normal(size=width).astype(np.float32).tolist(), int(r.integers(0, 3))))
    for b in range(4):
        centre = r.normal(size=width)
        for i in range(size):
            v = centre + r.normal(size=width) * 0.08 * np.linalg.norm(centre) / np.sqrt(width)
            rows.append((1000 + 100 * b + i, v.astype(np.float32).tolist(), b % 3))
    rows += [(5000 + i, rows[i][1], rows[i][2]) for i in range(5)]  # equal vectors
    return rows


def truth(rows, threshold=0.98):
    x = np.array([v for _, v, _ in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([c for _, _, c in rows])
    links = (x @ x.T >= threshold) & (label[:, None] == label)
    np.fill_diagonal(links, False)
    ids = np.array([i for i, _, _ in rows])
    root = ids.copy()
    while True:
        low = np.minimum(root, np.where(links, root[None, :], root.max()).min(axis=1))
        if (low == root).all():
            break
        root = low
    return {int(i): (int(n), int(r)) for i, n, r in zip(ids, links.sum(axis=1), root)}


@pytest.mark.parametrize("capacity", [2000, 60, 12])
def test_against_brute_force(spark, capacity):
    rows = balls()
    vectors = table(spark, rows)
    result = embeddings.linked(vectors, capacity=capacity)
    got = {r["vec_id"]: r for r in result.collect()}
    expected = truth(rows)
    assert set(got) == set(expected)
    assert all(got[i]["n_links"] <= n for i, (n, _) in expected.items())  # none is made up
    assert sum(r["n_links"] for r in got.values()) >= 0.95 * sum(n for n, _ in expected.values())
    assert sum(got[i]["component_id"] == c for i, (_, c) in expected.items()) >= 0.97 * len(rows)
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_audit(spark):
    rows = balls(n=400, size=60)
    vectors = table(spark, rows)
    result = embeddings.linked(vectors)
    row = embeddings.audit(vectors, result, every=3).first()
    expected = truth(rows)
    assert row["true"] == sum(n for i, (n, _) in expected.items() if i % 3 == 0)
    assert row["recall"] >= 0.9


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0, 2.0, 3.0]
    rows = [
        (1, one, 1), (2, one, 1), (2, one, 1), (3, [2.0, 4.0, 6.0], 1), (4, one, 2), (5, one, None), (6, None, 1), (7, [], 1),
        (8, [0.0, 0.0, 0.0], 1), (9, [nan, 1.0, 1.0], 1), (10, [inf, 1.0, 1.0], 1), (11, [None, 1.0, 1.0], 1), (None, one, 1), (None, [9.0, -1.0, 0.0], 1),
        (12, [1.0, 2.0], 1), (13, [1e-30, 2e-30, 3e-30], 1), (14, [1e30, 2e30, 3e30], 1),
    ]
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.linked(table(spark, rows)).collect()]
    group = 7  # 1, 2, 2, 3, null, 13 and 14
    expected = [(i, group - 1, 1, i == 1) for i in (1, 2, 2, 3, 13, 14)] + [(None, group - 1, 1, True)]
    expected += [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12)] + [(None, 0, None, True)]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_empty(spark):
    assert embeddings.linked(table(spark, [])).count() == 0


def test_pruning_keeps_what_no_kept_one_covers():
    x = np.array([[1, 0], [0.99, 0.141], [0.98, 0.199], [0, 1], [-1, 0]], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    kept = embeddings.robust_prune(x, np.array([0]), np.array([[1, 2, 3, 4]]))[0]
    assert kept[kept >= 0].tolist() == [1, 3, 4] or kept[kept >= 0].tolist() == [1, 3]


def clustered(n, width=64, seed=1):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(n // 20, width))
    x = centre[r.integers(0, len(centre), n)] + r.normal(size=(n, width)) * 0.12
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def searched(x, threshold=0.98):
    graph, built = embeddings.build_graph(x)
    q, e, asked = embeddings.range_search(x, graph, embeddings.medoids(x.astype(np.float32)), np.arange(len(x)), threshold)
    pairs = np.unique(np.minimum(q, e) * len(x) + np.maximum(q, e))
    sims = np.einsum("nd,nd->n", x[pairs // len(x)], x[pairs % len(x)])
    true = x @ x.T >= threshold
    np.fill_diagonal(true, False)
    return 2 * (sims >= threshold).sum() / true.sum(), built / len(x), asked / len(x)


def test_insertion_and_search_compare_few():
    """Similarities a vector takes grow with the logarithm of the members: 16 times as many cost less than three times as much."""
    small, large = searched(clustered(500)), searched(clustered(8000))
    assert small[0] >= 0.999 and large[0] >= 0.999
    assert large[1] < 3 * small[1] and large[2] < 3 * small[2]
    assert large[1] < 1000 and large[2] < 500  # of 7,999


def test_no_member_of_one_direction_is_lost():
    r = np.random.default_rng(3)
    x = r.normal(size=(1500, 32))
    x[:700] = x[0] * r.uniform(0.5, 2, size=(700, 1))
    recall, _, _ = searched(x / np.linalg.norm(x, axis=1, keepdims=True))
    assert recall >= 0.999


def test_graph_of_few():
    for n in (0, 1, 2, 3):
        graph, _ = embeddings.build_graph(clustered(20)[:n])
        assert [sorted(row[row >= 0].tolist()) for row in graph] == [[j for j in range(n) if j != i] for i in range(n)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="test tables are not here")
def test_audit_of_the_whole_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    row = embeddings.audit(vectors, embeddings.op4_embeddings(spark, "/root/testdata/sf0.1")).first()
    assert row["found"] <= row["true"] and row["recall"] >= 0.99
