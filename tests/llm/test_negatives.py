import duckdb
import numpy as np
import pytest

from castwise.llm import negatives

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "vec_id bigint, embedding array<float>, label int, lo bigint, shard string, ask int, v int, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, l, 1, "s", 2, 3, 4) for i, v, l in rows], SCHEMA)


def slow(rows, every=50, positives=5, k=3, low=50, high=95):
    """All products of all anchors, sorted."""
    kept = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        x = tuple(int(np.floor(256.0 * float(np.float32(c)))) for c in v)
        if all(abs(256.0 * float(np.float32(c))) < negatives.LARGEST for c in v):
            kept[i, label, x] = None
    out = []
    for i, label, x in kept:
        if i % every:
            continue
        others = sorted((-sum(a * b for a, b in zip(x, y)), j, m) for j, m, y in kept if j != i and len(y) == len(x))
        for s, j, m in [o for o in others if o[2] == label][:positives]:
            fits = [(t, n) for t, n, o in others if o != label and low * -s <= 100 * -t <= high * -s]
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n) in enumerate(fits[:k])]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def clustered(n, width=6, seed=3, labels=5):
    r = np.random.default_rng(seed)
    ends = r.normal(size=(labels, width))
    rows = []
    for i in range(n):
        label = int(r.integers(labels))
        mixed = ends[label] + 0.8 * ends[int(r.integers(labels))] + r.normal(0, 0.3, width)
        rows.append((i, [float(np.float32(x)) for x in mixed], label))
    return rows


@pytest.mark.parametrize("shard_rows", [40, 8192])
def test_equals_brute_force(spark, shard_rows):
    rows = clustered(700)
    # a hot vector, ties, one row of a label, negative scores only
    rows += [(1000 + i, [0.5] * 6, 9) for i in range(150)] + [(2000, [-9.0] * 6, 77), (2050, [-1.0] * 6, 78), (2051, [1.0] * 6, 78)]
    assert got(negatives.mine(frame(spark, rows), shard_rows=shard_rows)) == slow(rows)


def test_search_prunes_and_is_exact():
    r = np.random.default_rng(4)
    ends = r.normal(size=(40, 8)) * 300
    x = (ends[r.integers(0, 40, 4000)] + r.normal(0, 10, (4000, 8))).astype(np.int64)
    ids, labels = r.permutation(4000), r.integers(0, 3, 4000)
    tree = negatives.build(ids, labels, x)
    assert sorted(tree.ids.tolist()) == list(range(4000)) and tree.count[: tree.leaves].max() <= negatives.LEAF
    opened = 0
    for q in x[::400]:
        least, most = (b[0] for b in negatives.bounds(q[None, :], tree.lo, tree.hi))
        for leaf in range(tree.leaves):
            part = tree.x[tree.first[leaf]: tree.first[leaf] + tree.count[leaf]] @ q
            assert least[leaf] <= part.min() and part.max() <= most[leaf]
        score = x @ q
        order = np.lexsort((ids, -score))
        top = int(score.max())
        windows = [(-negatives.WIDE, negatives.WIDE), (top // 2, top * 9 // 10), (5, 4)]
        for same in (True, False):
            told = negatives.search(tree, q, own=-1, label=1, same=same, windows=windows, k=3, least=least, most=most)
            fit = [(int(score[i]), int(ids[i])) for i in order if (labels[i] == 1) == same]
            assert told == [[p for p in fit if lo <= p[0] <= hi][:3] for lo, hi in windows]
        opened += int((most[: tree.leaves] >= sorted(score, reverse=True)[2]).sum())
    assert opened < 10 * tree.leaves / 2


def test_large_numbers_stay_exact(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in r.uniform(20_000, 65_000, 5)], i % 2) for i in range(120)]
    rows += [(200, [65_536.0] * 5, 0), (250, [1e38] * 5, 1)]
    assert got(negatives.mine(frame(spark, rows))) == slow(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(None, [1.0, 2.0], 1), (0, None, 1), (0, [1.0, None], 1), (50, [nan, 1.0], 1), (50, [inf, 1.0], 1), (100, [], 1), (100, [1.0, 1.0], None),
           (150, [0.0, 0.0], 1), (151, [0.0, 0.0], 1), (152, [0.0, 1.0], 2), (-50, [1.0, 1.0], 1), (-51, [1.0, 0.9], 1), (-52, [0.9, 0.5], 2),
           (-52, [0.9, 0.5], 2), (200, [1.0, 1.0, 1.0], 1), (201, [1.0, 1.0, 1.0], 1), (202, [1.0, 0.5, 0.5], 3), (200, [1.0, 2.0, 1.0], 1)]
    assert got(negatives.mine(frame(spark, odd))) == slow(odd)
    assert got(negatives.mine(frame(spark, []))) == []
    assert got(negatives.mine(frame(spark, odd[:7]))) == []


def test_whole_table_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{FOLDER}/embeddings.parquet'")
    want = con.execute(f"select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ({negatives.SQL})").fetchall()
    assert want and got(negatives.op12_hard_negatives(spark, FOLDER)) == sorted(want)
