import math
import zlib
from collections import Counter

import numpy as np
import pytest

from castwise.llm import classlm
from castwise.llm.common import Stage
from tests.llm.conftest import prose

OPTIONS = dict(classes=4, exchanged=60, known=200, passes=3)


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def check_base(docs, rows, **options):
    counts = Counter()
    for i, t in rows:
        if not held(i):
            counts.update(classlm.tokens((t or "").encode()))
    total, space = sum(counts.values()), sum(counts.values()) + 0.1 * (len(counts) + 1)
    expected = []
    for i, t in rows:
        words = classlm.tokens((t or "").encode())
        base = sum(math.log10((counts[w] + 0.1) / space) for w in words)
        expected.append((str(i), held(i), len(words), sum(counts[w] > 0 for w in words), total, round(base, 6)))
    got = classlm.score_documents(docs, **options).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == sorted(expected)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    return got


def test_edges(frame, edges):
    check_base(frame(edges), edges, **OPTIONS)


def test_rare_words_are_looked_up(frame):
    rows = [(i, prose(i, 40) + f" only{i} " + "long" * 40) for i in range(50)]
    check_base(frame(rows), rows, classes=3, exchanged=20, known=30, passes=2)


def test_probabilities_add_up(spark, frame):
    """After any word the model's probabilities of all words, the end and one unseen word add up to one."""
    docs = frame([(i, prose(i, 60)) for i in range(30)])
    stage = Stage(spark, "test")
    texts = docs.selectExpr("cast(text as binary) as data")
    model, counts = classlm.train(texts, stage, **OPTIONS)
    number = {bytes(r["word"]): r["c"] for r in counts.collect()}
    for before in (b"", b"w1", b"w399", b"never"):
        lead = [before] if before else []
        total = 0.0
        for word in [*number, b"unseen"]:
            if word == classlm.END:
                text = b" ".join(lead)
                first = 0.0
            else:
                text = b" ".join([*lead, word])
            # the probability of one token: the difference of two texts' scores, the end's taken off
            total += 10 ** token_score(model, number, lead, word)
        assert abs(total - 1) < 1e-6


def token_score(model, number, lead, word):
    """log10 probability of ``word`` behind ``lead``, by the tables of the model."""
    kind = lambda w: int(model.word_class[model.ids.get(w, len(model.ids))])
    before = kind(lead[-1]) if lead else classlm.END_CLASS
    c, k = number.get(word, 0), kind(word)
    inside = model.emission[model.ids[word]] if k != classlm.OTHER_CLASS else (c + classlm.ADD) / model.other_space
    return math.log10(classlm.WEIGHT * model.transition[before, k] * inside + (1 - classlm.WEIGHT) * (c + classlm.ADD) / model.base_space)


def test_scores_follow_the_tables(spark, frame):
    rows = [(i, prose(i, 60)) for i in range(40)]
    stage = Stage(spark, "test")
    texts = frame(rows).selectExpr("cast(text as binary) as data")
    model, counts = classlm.train(texts, stage, **OPTIONS)
    number = {bytes(r["word"]): r["c"] for r in counts.collect()}
    for _, t in rows[:5]:
        words = classlm.tokens(t.encode())
        slow = sum(token_score(model, number, words[:i], w) for i, w in enumerate(words))
        n, known, base, score, rare = model.score(t.encode())
        more = sum(k * math.log10(number.get(w, 0) + classlm.ADD) for w, k in rare.items())
        assert score + more == pytest.approx(slow, abs=1e-6)


def test_exchange_finds_alternating_classes():
    """Words of two kinds that always alternate end up apart."""
    r = np.random.default_rng(2)
    seq = np.array([0] + [2 * r.integers(1, 6) + i % 2 for i in range(4000)])
    kinds = np.array([0] + [2 + i % 2 if i % 3 else 2 for i in range(1, 13)])
    for _ in range(6):
        left, right = np.zeros((13, 4)), np.zeros((13, 4))
        np.add.at(left, (seq[1:], kinds[seq[:-1]]), 1)
        np.add.at(right, (seq[:-1], kinds[seq[1:]]), 1)
        classlm.exchange(kinds, left, right)
    assert len(set(kinds[2:12:2])) == 1 and len(set(kinds[3:12:2])) == 1 and kinds[2] != kinds[3]


def test_better_than_base_on_held_out(spark):
    got = classlm.op6_class_lm(spark, "/root/testdata/sf0.01").filter("held_out").selectExpr("sum(score) as s", "sum(base_score) as b").first()
    assert got["s"] > got["b"]


def test_empty(frame):
    assert classlm.score_documents(frame([]), **OPTIONS).count() == 0


def test_words_outside_the_core_take_the_class_of_largest_gain(spark):
    """Against the mutual information of the whole class table with the word in each class, one by one."""
    r = np.random.default_rng(6)
    kinds, core, known = 6, 12, 30
    core_class = np.concatenate([[classlm.END_CLASS], classlm.FIRST_CLASS + np.arange(core - 1) % 4, [classlm.OTHER_CLASS]])
    texts = [np.concatenate([r.integers(1, known + 1, int(r.integers(0, 40))), [0]]).astype(np.uint32) for _ in range(60)]
    sequences = spark.createDataFrame([(bytearray(b"".join(t.tobytes() for t in texts[i: i + 7])),) for i in range(0, 60, 7)], "ids binary")
    table = r.integers(1, 50, (kinds, kinds)).astype(float)
    got = classlm._assigned(sequences, core_class, table, known)
    kind_of = np.concatenate([core_class[:core], np.full(known + 1 - core, classlm.OTHER_CLASS)])
    assert (got[:core] == core_class[:core]).all() and got[known] == classlm.OTHER_CLASS
    flat = np.concatenate([[0], *texts]).astype(int)

    def information(t):
        return (t * np.log(np.maximum(t, 1e-300))).sum() - sum(x * np.log(x) for x in t.sum(axis=1)) - sum(x * np.log(x) for x in t.sum(axis=0))

    for w in range(core, known):
        at = np.flatnonzero(flat == w)
        if not len(at):
            continue
        left, right = np.zeros(kinds), np.zeros(kinds)
        # texts of one batch follow one another, so the start of a batch and the end of the one before are the same end token
        np.add.at(left, kind_of[flat[at - 1]], 1)
        np.add.at(right, kind_of[flat[at + 1]], 1)
        gains = []
        for k in range(classlm.FIRST_CLASS, kinds):
            with_row, with_column = table.copy(), table.copy()
            with_row[k] += right
            with_column[:, k] += left
            gains.append(_rows(with_row) - _rows(table) + _columns(with_column) - _columns(table))
        assert got[w] == classlm.FIRST_CLASS + int(np.argmax(gains)), w
    full = classlm._transitions(sequences, got, kinds)
    want = np.zeros((kinds, kinds))
    for t in [texts[i: i + 7] for i in range(0, 60, 7)]:
        kind = got[np.concatenate([[0], *t]).astype(int)]
        np.add.at(want, (kind[:-1], kind[1:]), 1)
    assert (full == want).all()


def _rows(t):
    return (t * np.log(np.maximum(t, 1e-300))).sum() - sum(x * np.log(x) for x in t.sum(axis=1))


def _columns(t):
    return (t * np.log(np.maximum(t, 1e-300))).sum() - sum(x * np.log(x) for x in t.sum(axis=0))
