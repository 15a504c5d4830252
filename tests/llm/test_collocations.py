import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np

from castwise.llm import collocations
from tests.llm.conftest import prose

FOLDER = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow(rows, least, top=2000, inside=80):
    """All counts in dictionaries of word tuples."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(words)
            for i in range(len(words)):
                for k in range(1, 5):
                    if i + k <= len(words):
                        f[lang or "und"][tuple(words[i: i + k])] += 1
    out = []
    for lang, counted in f.items():
        found = {p: a for p, a in counted.items() if len(p) > 1 and a >= least}
        around = Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for s in range(len(p) - m + 1):
                    around[p[s: s + m]] = max(around[p[s: s + m]], a)
        kept = []
        for p, a in found.items():
            if 100 * around[p] >= inside * a:
                continue
            score, k = min((2_000_000 * a // (counted[p[:k]] + counted[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), counted[p[:k]], counted[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top]):
            out.append((lang, rank + 1, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def docs(spark, rows):
    return spark.createDataFrame([(i, text, lang, "f", 1, "w", 2, 3) for i, (lang, text) in enumerate(rows)],
                                 "doc_id bigint, text string, lang string, f string, w1 int, word string, bucket int, h int")


def sentences(seed, n, words=12):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["ab", "Ab"]
    return " ".join(r.choice(vocabulary) + r.choice(["", "", "", "", ".", ",", "\n", "\t"]) for _ in range(n))


def test_equals_brute_force(spark):
    rows = [("en", sentences(i, 400)) for i in range(12)] + [("de", sentences(i, 300, 5)) for i in range(20, 26)] + [(None, sentences(99, 500))]
    assert got(collocations.collocations(docs(spark, rows), least=4)) == slow(rows, 4)
    assert got(collocations.collocations(docs(spark, rows), least=4, top=7)) == slow(rows, 4, top=7)


def test_rare_words_and_hot_words(spark, monkeypatch):
    """One word is a third of all, most others are rare; blocks and ranges are small."""
    r = random.Random(5)
    rows = [("en", " ".join(r.choice(["the", "of", f"x{r.randrange(300)}", f"y{r.randrange(9)}"]) for _ in range(2_000))) for _ in range(10)]
    rows += [("en", "the the the the the the the the of the line that all have")] * 200
    want = slow(rows, 30)
    assert got(collocations.collocations(docs(spark, rows))) == want and want
    # a map of few bits lets rare words through
    monkeypatch.setattr(collocations, "BITS", 1 << 15)
    monkeypatch.setattr(collocations, "ASKED", 50)
    assert got(collocations.collocations(docs(spark, rows))) == want


def test_transducer_is_minimal_and_complete():
    r = np.random.default_rng(3)
    stream = r.integers(0, 6, 4_000).astype(np.uint64)
    labels, rows, counts = collocations.windows(stream)
    plain = Counter()
    for i in range(len(stream)):
        run = []
        for x in stream[i: i + 4].tolist():
            if x == 0:
                break
            run.append(x)
        if len(run) > 1:
            plain[tuple(run + [0] * (4 - len(run)))] += 1
    assert {tuple(int(labels[j]) for j in row): int(c) for row, c in zip(rows, counts)} == dict(plain)
    assert [tuple(x) for x in rows.tolist()] == sorted(tuple(x) for x in rows.tolist())
    made = collocations.build(rows, counts)
    for starts, arcs in (("starts2", "arcs2"), ("starts3", "arcs3")):
        states = [made[arcs][a:b].tobytes() for a, b in zip(made[starts][1:], made[starts][2:])]
        assert len(states) == len(set(states)) and all(states)
    # the same register as adding one node's arcs at a time
    by_third = defaultdict(list)
    for row, c in zip(rows.tolist(), counts.tolist()):
        if row[3]:
            by_third[tuple(row[:3])].append((row[3], c))
    assert len(made["starts3"]) - 2 == len({tuple(v) for v in by_third.values()})


def test_union_adds_weights():
    r = np.random.default_rng(4)
    streams = [r.integers(0, 5, n).astype(np.uint64) for n in (50, 500, 3, 700)]
    total = Counter()
    for s in streams:
        for i in range(len(s)):
            for k in range(2, 5):
                part = tuple(s[i: i + k].tolist())
                if len(part) == k and 0 not in part:
                    total[part] += 1
    for hot in (np.zeros(0, np.uint64), np.array([1, 3], np.uint64)):
        pieces = defaultdict(list)
        for s in streams:
            for p in collocations.shard("en", s, hot, 3):
                pieces[p["bucket"]].append(p)
        found = Counter()
        for group in pieces.values():
            for words, f, complete in collocations.united(group, hot, 7):
                for w, c, ok in zip(words.tolist(), f.tolist(), complete):
                    key = tuple(x for x in w if x)
                    assert not ok or key not in found
                    found[key] += c
        assert {k: c for k, c in found.items() if c >= 7} == {k: c for k, c in total.items() if c >= 7}


def test_look_up_walks_paths():
    phrases = np.array([[5, 0, 0, 0], [5, 7, 0, 0], [5, 7, 9, 0], [2**63, 5, 0, 0]], np.uint64)
    asked = np.array([[5, 7, 0, 0], [7, 0, 0, 0], [5, 7, 9, 0], [5, 0, 0, 0], [5, 7, 9, 1], [2**63, 5, 0, 0], [2**63, 0, 0, 0]], np.uint64)
    assert collocations.look_up(phrases, np.array([4, 3, 2, 8]), asked).tolist() == [3, 0, 2, 4, 0, 8, 0]
    assert collocations.look_up(phrases[:0], np.zeros(0, np.int64), asked).tolist() == [0] * 7


def test_edges(spark, frame, edges):
    rows = [("en", t) for _, t in edges]
    assert got(collocations.collocations(frame(edges), least=2)) == slow(rows, 2)
    assert got(collocations.collocations(frame([]))) == []
    assert got(collocations.collocations(frame([(1, None), (2, "")]))) == []
    long = " ".join(prose(8, 100) for _ in range(300))
    assert got(collocations.collocations(docs(spark, [("en", long), ("en", "Öl Öl.Öl\x00 Öl\x1cx  \t Öl Öl")]), least=2)) == slow(
        [("en", long), ("en", "Öl Öl.Öl\x00 Öl\x1cx  \t Öl Öl")], 2)


def test_whole_table_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{FOLDER}/documents.parquet'")
    want = con.execute(f"select lang, rank, phrase, a, l, r, n, score from ({collocations.SQL})").fetchall()
    assert want and got(collocations.op13_collocations(spark, FOLDER)) == sorted(want)
