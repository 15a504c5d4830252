import random

import pytest
import xxhash

from castwise.llm import simhash
from castwise.llm.common import Stage, components
from tests.llm.conftest import prose


def slow_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i: i + 3]) for i in range(max(1, len(words) - 2))]
    out = 0
    for bit in range(64):
        ones = sum(xxhash.xxh64_intdigest(s, seed=42) >> bit & 1 for s in shingles)
        out |= (ones * 2 > len(shingles)) << bit
    return out


def slow_components(prints):
    ids = {}
    for i, f in prints:
        ids.setdefault(f, []).append(i)
    todo, out = set(ids), {}
    while todo:
        group, grow = set(), [todo.pop()]
        while grow:
            f = grow.pop()
            group.add(f)
            near = {g for g in todo if bin(f ^ g).count("1") <= 2}
            todo -= near
            grow += near
        named = [i for f in group for i in ids[f] if i is not None]
        out.update({f: min(named, default=None) for f in group})
    return out


def check(docs, rows):
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    prints = [(i, slow_print(t)) for i, t in rows]
    of = slow_components(prints)
    assert got == sorted((i is not None, i or 0, f"{f:016x}", of[f]) for i, f in prints)


def test_edges(frame, edges):
    check(frame(edges), edges)


def test_near_copies(frame):
    base, rows = prose(3, 400).split(), []
    for i in range(60):
        words = list(base)
        words[i * 6] = "other"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, prose(50 + i, 60)) for i in range(40)]
    check(frame(rows), rows)


def test_fingerprint_in_chunks():
    text = prose(9, 500)
    whole = simhash.fingerprint(text.encode())
    assert whole % (1 << 64) == slow_print(text)
    assert simhash.fingerprint(text.encode(), chunk=37) == whole


@pytest.mark.parametrize("dense", [0, 3, 1000])
def test_crowded_keys_link_alike(spark, dense):
    r = random.Random(4)
    prints = set()
    for _ in range(12):
        f = r.getrandbits(64)
        for _ in range(12):
            prints.add(f)
            f ^= (1 << r.randrange(64)) ^ (1 << r.randrange(64))
    prints |= {0, (1 << 64) - 1, 1 << 63, 3}
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    stage = Stage(spark, "test")
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "f bigint"), 2, stage, dense=dense)
    roots = {r["node"]: r["root"] for r in components(edges, stage).collect()}
    of = slow_components([(f, f) for f in prints])
    for f in prints:
        for g in prints:
            s, t = (x - (1 << 64) if x >> 63 else x for x in (f, g))
            assert (roots.get(s, s) == roots.get(t, t)) == (of[f] == of[g])


def test_one_of_each_stays(frame, edges):
    kept = simhash.keep_one(frame(edges))
    got = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    of = slow_components([(i, slow_print(t)) for i, t in edges])
    assert got == sorted({v for v in of.values() if v is not None})
    assert kept.filter("doc_id is null").count() == sum(i is None for i, _ in edges)
    assert kept.columns == frame(edges).columns


def test_empty(frame):
    assert simhash.near_duplicates(frame([])).count() == 0
    assert simhash.keep_one(frame([])).count() == 0
