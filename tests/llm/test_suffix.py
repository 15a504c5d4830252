import hashlib
import random

import numpy as np
import pytest

from castwise.llm import suffix
from tests.llm.conftest import prose


def slow(rows, length):
    """(id, bytes, removed flags) of every row, by looking at every string."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - length + 1):
                g = b[p: p + length]
                first[g] = min(i, first.get(g, i))
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if i is not None and first.get(b[p: p + length], i) < i:
                gone[p: p + length] = b"\1" * length
        yield i, b, gone


def told(rows, length=50):
    out = []
    for i, b, gone in slow(rows, length):
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out.append((i is not None, i or 0, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def check(docs, rows, length=50):
    got = suffix.removed(docs, length=length)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()) == told(rows, length)


def cases(seed):
    r = random.Random(seed)
    passages = [prose(1000 + i, 12)[: r.randint(48, 70)] for i in range(6)]
    rows = []
    for i in range(40):
        parts = []
        for _ in range(r.randint(0, 6)):
            parts.append(r.choice(passages) if r.random() < 0.6 else prose(r.randrange(10**6), r.randint(1, 20)))
        rows.append((i, r.choice(["", " ", "\n"]).join(parts)))
    rows += [(50 + i, "ab" * r.randint(20, 60)) for i in range(5)] + [(60 + i, "la " * 30 + str(i)) for i in range(4)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_every_string(frame, seed):
    check(frame(cases(seed)), cases(seed))


def test_edges(frame, edges):
    check(frame(edges), edges)


def test_other_lengths(frame):
    rows = cases(3)
    check(frame(rows), rows, length=37)
    with pytest.raises(ValueError):
        suffix.removed(frame(rows), length=20)


def test_crowded_grams(frame, monkeypatch):
    line = "one very common line that begins many texts "
    rows = [(i, f"{line}{prose(i % 7, 3)} {prose(i, 5)}") for i in range(30)]
    monkeypatch.setattr(suffix, "CROWDED", 2)
    check(frame(rows), rows)


def test_long_runs(frame, monkeypatch):
    monkeypatch.setattr(suffix, "LONGEST_RUN", 16)
    rows = [(1, "x" * 200 + "end"), (2, "y" + "x" * 150), (3, "x" * 75), (4, "abcabc" * 40)]
    check(frame(rows), rows)


def test_intervals_against_every_string():
    r = random.Random(8)
    data = [bytes(r.choice(b"ab") for _ in range(r.randint(40, 90))) + prose(i % 3, 10).encode() for i in range(12)]
    doc = np.array([i // 2 for i in range(12)])
    size = np.array([len(x) for x in data], np.uint32)
    got = suffix.repeats(doc, size, b"".join(data), 50).tolist()
    first = {}
    for d, x in zip(doc, data):
        for p in range(len(x) - 49):
            first[x[p: p + 50]] = min(d, first.get(x[p: p + 50], d))
    expected, base = [], 0
    for d, x in zip(doc, data):
        expected += [base + p for p in range(len(x) - 49) if first[x[p: p + 50]] < d]
        base += len(x)
    assert got == expected


def test_texts_are_cut(frame, edges):
    rows = cases(4) + [(900, None)]
    got = {r["doc_id"]: r["text"] for r in suffix.deduplicated(frame(rows)).collect()}
    for i, b, gone in slow(rows, 50):
        kept = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
        if any(gone) and not kept.strip():
            assert i not in got
        elif i != 900:
            assert got[i] == kept
    assert got[900] is None
    assert suffix.deduplicated(frame(edges)).columns == frame(edges).columns


def test_empty(frame):
    assert suffix.removed(frame([])).count() == 0
    assert suffix.deduplicated(frame([])).count() == 0


def test_texts_of_one_id_are_told_apart(spark, frame):
    """Thousands of texts under one id, some with a passage of a smaller document: each loses its own spans only."""
    passage = prose(70, 30)
    rows = [(1, passage)] + [(5, f"{prose(1000 + i, 6)} {passage if i % 7 == 0 else prose(5000 + i, 30)}") for i in range(1500)]
    lost = sorted(r["n_removed"] for r in suffix.removed(frame(rows)).filter("doc_id = 5").collect())
    cut = len(passage.encode())
    assert sum(n >= cut for n in lost) == len([i for i in range(1500) if i % 7 == 0]) and lost[0] == 0


def test_columns_named_like_those_inside(spark, edges):
    rows = [(i, t, "a", "b", 1) for i, t in edges]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, doc_of_row string, data_of_row string, shard_of_row int")
    got = suffix.deduplicated(docs)
    assert got.columns == docs.columns and {(r["doc_of_row"], r["data_of_row"], r["shard_of_row"]) for r in got.collect()} == {("a", "b", 1)}
