import random
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from castwise.operators import sets
from castwise.operators import similarity as S
from castwise.operators.sets import closest_document
from castwise.session import staged_folders


def _norm(t):
    return " ".join(t.lower().split())


@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.9])
def test_short_texts_against_brute_force(spark, threshold):
    rng = random.Random(int(threshold * 100))
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 6)))
    base = [" ".join(word() for _ in range(rng.randint(1, 5))) for _ in range(60)]

    def edit(t):
        chars = list(t)
        for _ in range(rng.randint(0, 3)):
            chars.insert(rng.randint(0, len(chars)), rng.choice("abcde "))
        return "".join(chars).upper() if rng.random() < 0.3 else "".join(chars)

    cands = [(i, edit(rng.choice(base))) for i in range(80)] + [(900, ""), (901, "  "), (902, None), (903, "a"), (904, "ab")]
    corpus = base + ["", "a", "abc", base[0] + "  "]
    got = {r["k"]: r for r in S.closest_short_text(
        spark.createDataFrame(cands, "k int, t string"), spark.createDataFrame([(b,) for b in corpus], "c string"), "k", "t", "c", threshold
    ).collect()}
    assert len(got) == len(cands)
    for k, t in cands:
        best = max(SequenceMatcher(None, _norm(t or ""), _norm(b), False).ratio() for b in corpus)
        assert got[k]["is_duplicate"] == (best >= threshold), (t, best)
        assert got[k]["max_similarity"] == pytest.approx(best if best >= threshold else 0.0)


def test_short_text_gate(spark):
    corpus = spark.createDataFrame([("The Secret Reason Rome Collapsed",), ("Why We Procrastinate",)], "c string")
    cands = spark.createDataFrame([(1, "The Secret Reason Rome Collapsed"), (2, "How Ants Build Colonies")], "k int, t string")
    got = {r["k"]: r for r in S.closest_short_text(cands, corpus, "k", "t", "c").collect()}
    assert got[1]["is_duplicate"] and got[1]["max_similarity"] > 0.99 and not got[2]["is_duplicate"]
    none = S.closest_short_text(cands, corpus.filter("false"), "k", "t", "c").collect()
    assert all(not r["is_duplicate"] and r["max_similarity"] == 0.0 for r in none)
    assert S.char_ratio("psychology of fear", "quantum chromodynamics") < 0.5


def _shingles(t):
    w = _norm(t).split()
    return {tuple(w[i:i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())


def _corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(200)]
    template = [rng.choice(vocab) for _ in range(60)]
    other = [rng.choice(vocab) for _ in range(30)]
    docs = []
    for _ in range(30):  # near copies of a template, each with words of its own
        t = list(template)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = f"u{rng.randrange(10**6)}"
        docs.append(" ".join(t))
    for _ in range(15):  # pieces of boilerplate and nothing else
        a = rng.randint(0, 6)
        docs.append(" ".join(template[a:a + rng.randint(40, 54)] + (other if rng.random() < 0.3 else [])))
    docs += [docs[0]] * 6 + [docs[35].upper()] * 5 + ["", "  ", "x y", "x  Y", "x y z"]
    docs += [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 50))) for _ in range(20)]
    rng.shuffle(docs)
    return [(i, t, rng.random() < 0.6) for i, t in enumerate(docs)]


@pytest.mark.parametrize("threshold, seed", [(0.8, 4), (0.8, 1000), (0.8, 1), (0.5, 6), (0.3, 3), (0.15, 5), (1.0, 8)])
def test_documents_against_brute_force(spark, threshold, seed):
    docs = _corpus(seed)
    got = {r["doc_id"]: r for r in closest_document(
        spark.createDataFrame(docs, "doc_id long, text string, existing boolean"), threshold).collect()}
    sets = {i: _shingles(t) for i, t, _ in docs}
    assert len(got) == len(docs)
    for i, _, _ in docs:
        best = max((len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j, _, e in docs
                    if e and j != i and sets[i] and sets[j]), default=0.0)
        assert got[i]["max_similarity"] == pytest.approx(best if best >= threshold else 0.0), (i, best)
        assert got[i]["is_duplicate"] == (best >= threshold)


def _lists(spark, docs, threshold):
    frame = spark.createDataFrame(docs, "doc_id long, text string, existing boolean")
    rows = sets.shingle_sets(frame).filter("n > 0").select(F.col("doc_id").alias("rep"), "n", F.col("existing").alias("e"), F.explode("sh").alias("s"))
    return sets.ordered(rows, threshold)


def test_a_shingle_in_every_text_makes_no_pairs(spark):
    """Texts that share one line and are otherwise their own meet nowhere; nothing is lost."""
    rng = random.Random(2)
    own = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    docs = [(i, f"all rights reserved here {own(60)}", True) for i in range(400)]
    docs += [(1000, docs[5][1] + " tail", True)]
    lists = _lists(spark, docs, 0.8)
    assert {tuple(sorted(r)) for r in sets.candidates(lists, 0.8).collect()} == {(5, 1000)}
    got = {r["doc_id"] for r in closest_document(spark.createDataFrame(docs, "doc_id long, text string, existing boolean")).collect() if r["is_duplicate"]}
    assert got == {5, 1000}


def test_no_filter_loses_a_pair(spark):
    docs = [d for d in _corpus(21) if d[1].split()]
    texts = {i: _shingles(t) for i, t, _ in docs}
    for threshold in (0.8, 0.4, 0.15):
        found = {tuple(r) for r in sets.candidates(_lists(spark, docs, threshold), threshold).collect()}
        near = {(i, j) for i, _, _ in docs for j, _, e in docs
                if e and i != j and len(texts[i] & texts[j]) >= threshold * len(texts[i] | texts[j]) - 1e-12}
        # texts of one set of shingles are one text to the operator and never meet here
        assert near <= found, threshold


def test_compared_pairs_grow_with_the_table(spark):
    count = lambda folder: sets.candidates(
        sets.ordered(sets.shingle_sets(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", F.lit(True).alias("existing")))
                     .filter("n > 0").dropDuplicates(["key"]).select(F.col("doc_id").alias("rep"), "n", F.lit(True).alias("e"), F.explode("sh").alias("s")), 0.8), 0.8).count()
    small, large = count("/root/testdata/sf0.01"), count("/root/testdata/sf0.1")
    assert 0 < large <= 15 * small


def test_originality(spark):
    df = spark.createDataFrame([(0.25, "text"), (0.0, ""), (1.0, "x")], "s double, t string")
    assert [r[0] for r in df.select(S.originality(F.col("s"), F.col("t"))).collect()] == [75.0, 0.0, 0.0]


@pytest.mark.parametrize("block, threshold", [(5, 0.8), (64, 0.8), (7, 0.3)])
def test_vectors_against_brute_force(spark, block, threshold):
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(6, 8))
    v = [centres[rng.integers(6)] * rng.uniform(0.5, 2) + rng.normal(scale=0.35, size=8) for _ in range(90)]
    v += [v[0], v[0], v[3], np.zeros(8), np.zeros(8)]
    rows = [(i, [float(x) for x in vec]) for i, vec in enumerate(v)]
    got = {r["vec_id"]: r for r in S.closest_vector(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>"), threshold, block=block).collect()}
    m = np.array(v)
    norms = np.linalg.norm(m, axis=1)
    unit = m / np.where(norms == 0, 1, norms)[:, None]
    sims = unit @ unit.T
    np.fill_diagonal(sims, -1)
    assert len(got) == len(rows)
    for i in range(len(v)):
        best = sims[i].max()
        assert got[i]["max_similarity"] == pytest.approx(best if best >= threshold else 0.0, abs=1e-6)


@pytest.mark.parametrize("same", [True, False])
def test_blocks_of_vectors_against_brute_force(monkeypatch, same):
    """Every vector of two blocks gets its highest cosine with the other block, whatever tiles it is in; single precision decides nothing."""
    monkeypatch.setattr(S, "TILE", 16)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 12))
    u = centres[rng.integers(9, size=300)] + rng.normal(scale=0.3, size=(300, 12))
    u = u / np.linalg.norm(u, axis=1)[:, None]
    own = np.zeros(300, np.int32) if same else rng.integers(2, size=300).astype(np.int32)
    table = pa.table({"node": np.arange(300), "u": pa.array(u.tolist()), "bucket": rng.integers(5, size=300) if same else (u[:, 0] > 0) * 2 + (u[:, 1] > 0),
                      "own": own, "i": np.zeros(300, np.int32), "j": np.full(300, 0 if same else 1, np.int32)})
    sims = u @ u.T
    sims[np.eye(300, dtype=bool) if same else own[:, None] == own[None, :]] = -1
    best = sims.max(axis=1)
    threshold = float(np.sort(best)[150])  # a pair lies just at it
    got = S._best_of_pair(table, 12, threshold - 1e-12).to_pydict()
    assert dict(zip(got["node"], got["sim"])) == pytest.approx({i: x for i, x in enumerate(best) if x >= threshold - 1e-12}, abs=1e-12)


def test_vectors_travel_a_bounded_number_of_times(spark):
    assert [S.block_count(n, 64, 2048) for n in (1, 5_000, 100_000, 1_500_000)] == [1, 3, 24, 24]
    rows = spark.range(500).select(F.col("id").alias("node"), F.array(F.lit(1.0)).alias("u"), F.lit(0).alias("bucket"))
    met = S.block_pairs(rows, 24)
    assert met.groupBy("node").count().agg(F.max("count")).first()[0] == 24
    # any two vectors are in one task
    assert {r["node"]: r["n"] for r in met.filter("i = own or j = own").groupBy("node").agg(F.countDistinct("i", "j").alias("n")).collect()} == dict.fromkeys(range(500), 24)


def test_cosine_of_a_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 2.0], [2.0, 4.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in df.select(S.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0]


def test_a_text_is_not_compared_with_itself(spark):
    rows = spark.createDataFrame([(1, "red ring"), (2, "blue gear"), (3, "red ring"), (4, "lonely topic"), (5, "lonely topics")], "k long, t string")
    existing = rows.select(F.col("k").alias("e"), F.col("t").alias("x"))
    got = {r["k"]: r["max_similarity"] for r in S.closest_short_text(rows, existing, "k", "t", "x", existing_key="e").collect()}
    assert got[1] == got[3] == 1.0 and got[2] == 0.0
    assert 0.8 <= got[4] < 1 and got[4] == got[5]


def test_unusable_vectors_stay(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [2.0, 0.0]), (6, [1.0, None])]
    got = {r["vec_id"]: (r["max_similarity"], r["is_duplicate"]) for r in S.closest_vector(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1.0, True), 2: (0.0, False), 3: (0.0, False), 4: (0.0, False), 5: (1.0, True), 6: (0.0, False)}


def test_vector_buckets_prune_clusters(spark):
    """Compared pairs per vector grow far slower than the table: ten times the clustered vectors, under four times the pairs."""
    def pairs_per_vector(n):
        rng = np.random.default_rng(7)
        centres = rng.normal(size=(n // 10, 32))
        v = centres[rng.integers(n // 10, size=n)] + rng.normal(scale=0.2, size=(n, 32))
        u = v / np.linalg.norm(v, axis=1)[:, None]
        bits, tables = S.lsh_shape(n, 0.8, 0.99)
        rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(u)], "node long, u array<double>")
        met = S.vector_buckets(rows, 32, bits, tables).groupBy("table", "bucket").count()
        return met.selectExpr("sum(count * count)").first()[0] / n

    small, large = pairs_per_vector(1_000), pairs_per_vector(10_000)
    assert large < 4 * small


def test_meetings_are_counted_in_parts_and_blocks(spark, monkeypatch):
    """Long sets are cut into parts and dealt to blocks; every pair at the threshold is found and hardly any other goes on."""
    rng = random.Random(31)
    words = [f"w{i}" for i in range(4000)]
    base = [[rng.choice(words) for _ in range(rng.choice((40, 300, 700)))] for _ in range(12)]
    docs = []
    for i in range(90):
        t = [rng.choice(words) if rng.random() < (0.02, 0.2)[i % 2] else w for w in base[i % 12]] + ["the"] * 5
        docs.append((i, " ".join(t), i % 3 > 0))
    texts = {i: _shingles(t) for i, t, _ in docs}
    monkeypatch.setattr(sets, "BLOCK", 900)
    for threshold in (0.8, 0.15):
        found = {tuple(r) for r in sets.candidates(_lists(spark, docs, threshold), threshold).collect()}
        near = {(i, j) for i, _, _ in docs for j, _, e in docs
                if e and i != j and len(texts[i] & texts[j]) >= threshold * len(texts[i] | texts[j]) - 1e-12}
        assert near and near <= found and len(found) <= 3 * len(near), threshold


@pytest.mark.parametrize("threshold", [0.8, 0.15])
def test_a_corpus_in_pieces_gives_the_result_of_one(spark, monkeypatch, threshold):
    """Sizes that one piece cannot hold are cut into shares; every row keeps its closest other text."""
    monkeypatch.setattr(sets, "HELD", 400)
    docs = _corpus(12)
    got = {r["doc_id"]: r["max_similarity"] for r in closest_document(
        spark.createDataFrame(docs, "doc_id long, text string, existing boolean"), threshold).collect()}
    texts = {i: _shingles(t) for i, t, _ in docs}
    assert len(got) == len(docs)
    for i, _, _ in docs:
        best = max((len(texts[i] & texts[j]) / len(texts[i] | texts[j]) for j, _, e in docs if e and j != i and texts[i] and texts[j]), default=0.0)
        assert got[i] == pytest.approx(best if best >= threshold else 0.0), (i, best)


def test_texts_that_are_all_alike_write_no_pairs(spark):
    """Near copies of one text: no shingles of pairs are joined or shuffled, and every piece leaves one row for each text at most."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    docs = []
    for i in range(300):
        t = list(base)
        t[rng.randrange(120)] = f"u{i}"
        docs.append((i, " ".join(t), True))
    before = len(staged_folders())
    out = closest_document(spark.createDataFrame(docs, "doc_id long, text string, existing boolean"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "tokens" in x and "Relation" not in x], plan
    assert out.filter("is_duplicate").count() == 300
    assert sum(spark.read.parquet(x).count() for x in staged_folders()[before:]) == 600


def test_pieces_hold_what_they_may():
    sizes = [(3, 10), (5, 2), (400, 7), (401, 1), (402, 1)]
    got = sets._pieces(sizes, 1000)
    assert got == [(3, 5, 1), (400, 400, 3), (401, 402, 1)]
    assert sets._pieces([], 10) == []
