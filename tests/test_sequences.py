import random

import pytest
from pyspark.sql import functions as F

from castwise import params as P
from castwise.operators import joins, ranking
from castwise.operators.sequences import interleave, largest_remainder, positions, running_totals
from castwise.plans import schedule


@pytest.mark.parametrize("block", [3, 7, 1000])
def test_running_totals_across_blocks(spark, block):
    rng = random.Random(block)
    rows = [(g, i, rng.randint(0, 9)) for g, n in (("hot", 50), ("cold", 4), ("one", 1)) for i in range(n)]
    shuffled = rng.sample(rows, len(rows))
    df = spark.createDataFrame(shuffled, "g string, i int, v int")
    got = {(r["g"], r["i"]): (r["total"], r["n"]) for r in running_totals(
        df, ["g"], "i", {"total": F.col("v"), "n": (F.col("v") > 4).cast("int")}, block).collect()}
    sums, counts = {}, {}
    for g, i, v in rows:
        sums[g], counts[g] = sums.get(g, 0) + v, counts.get(g, 0) + (v > 4)
        assert got[(g, i)] == (sums[g], counts[g])
    assert len(got) == len(rows)


def test_positions_of_a_hot_group(spark):
    rng = random.Random(1)
    rows = [(1 if rng.random() < 0.7 else rng.randint(2, 5), v) for v in rng.sample(range(10_000), 600)]
    df = spark.createDataFrame(rows, "g int, v int").repartition(5)
    got = {(r["g"], r["v"]): r["position"] for r in positions(df, ["g"], [F.col("v").desc()]).collect()}
    for g in {g for g, _ in rows}:
        for i, v in enumerate(sorted((v for h, v in rows if h == g), reverse=True)):
            assert got[(g, v)] == i + 1


def test_largest_remainder(spark):
    shares = [0.5, 0.3, 0.2]
    got = spark.range(1, 40).select("id", largest_remainder(shares, F.col("id")).alias("c")).collect()
    for r in got:
        assert sum(r["c"]) == r["id"]
        assert all(abs(c - s * r["id"]) < 1 for c, s in zip(r["c"], shares))
    assert [r["c"] for r in got if r["id"] == 4] == [[2, 1, 1]]


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_interleave_takes_the_fullest_in_rotating_order(spark, k):
    rng = random.Random(k)
    cases = [[rng.randint(0, 6) for _ in range(k)] for _ in range(25)] + [[0] * k]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c array<int>")
    for r in df.select("c", interleave(F.col("c"), k).alias("s")).collect():
        left, expected = list(r["c"]), []
        while sum(left):
            p = len(expected)
            best = max(((p + j) % k for j in range(k)), key=lambda x: left[x])
            expected.append(best)
            left[best] -= 1
        assert r["s"] == expected


def test_calendar_is_balanced_and_never_repeats(spark):
    channels = spark.createDataFrame([(1, "2026-01-01")], "channel_id int, start string").withColumn("start", F.to_date("start"))
    rules = P.CalendarRules(days=42)
    slots = schedule.calendar(channels, rules).orderBy("slot").collect()
    assert {s["category"] for s in slots} == {"psychology", "history"} and len(slots) == 24
    assert slots[0]["date"] == "2026-01-02" and slots[0]["format"] == "short"
    for a, b in zip(slots, slots[1:]):
        assert (a["category"], a["subcategory"]) != (b["category"], b["subcategory"])
    check = schedule.adjacent_repeats(schedule.calendar(channels, rules)).first()
    assert (check["slots"], check["psychology_slots"], check["adjacent_repeats"]) == (24, 12, 0)
    batch = schedule.plan_batch(schedule.calendar(channels, rules), 2, "both", "long").collect()
    assert [b["weekday"] for b in batch] == ["Sun", "Sun"]
    with pytest.raises(ValueError):
        schedule.calendar(channels, P.CalendarRules(mix={"space": 1.0}))


def test_ranking_helpers(spark):
    df = spark.createDataFrame([(1, 0, "B "), (1, 1, "b"), (1, 2, ""), (1, 3, None), (2, 0, "a")], "g int, pos int, t string")
    first = ranking.first_occurrence(df, F.trim(F.lower("t")), [F.col("pos")], within=["g"]).collect()
    assert sorted((r["g"], r["pos"]) for r in first) == [(1, 0), (2, 0)]
    back = spark.createDataFrame([(1, 9, "x"), (2, 9, "y"), (3, 9, "z")], "g int, pos int, t string")
    filled = ranking.fill_if_short(df.filter("t <> ''"), back, ["g"], 2).collect()
    assert sorted((r["g"], r["t"]) for r in filled if r["source_rank"] == 1) == [(2, "y"), (3, "z")]


def test_update_insert_lookup(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, None, 3)], "id int, s string, n int")
    changes = spark.createDataFrame([(1, "x", 2), (1, "old", 1), (3, "y", 1), (9, "z", 1)], "id int, s string, at int")
    got = joins.keyed_update(base, changes, "id", ["s"], [F.col("at").desc()]).orderBy("id").collect()
    assert [(r["id"], r["s"], r["n"]) for r in got] == [(1, "x", 1), (2, "b", 2), (3, "y", 3)]
    new = joins.insert_if_absent(base, changes, "id", [F.col("at")]).collect()
    assert [(r["id"], r["s"]) for r in new] == [(9, "z")]
    look = base.select(joins.lookup({"a": 5.0}, F.col("s"), 0.0).alias("v")).collect()
    assert [r["v"] for r in look] == [5.0, 0.0, 0.0]
    cyc = spark.range(5).select(joins.cycle(F.array(F.lit("p"), F.lit("q")), F.col("id")).alias("v")).collect()
    assert [r["v"] for r in cyc] == ["p", "q", "p", "q", "p"]
