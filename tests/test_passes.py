import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from castwise import params as P
from castwise.functions import passes
from castwise.functions import text as X
from castwise.plans import timeline

ODD = ["", " ", "a", "One. Two!  Three?x Four.", "[HOOK] a [BODY]b [HOOK] c", "don't STOP 3rd ßa aß éÉ ªx", "x" * 5000, "a.b.c", "...", "Ärger über Öl. İstanbul DŽ\n\n\n\nend",
       "\t tabs\x0b and\x0cfeeds \r\n", "The Of the of THE OF", "aa[b]a", "no end", "word " * 300, "A. B. Cdef. Ghij", "日本 語x Ωmega", "²x²y ǆ"]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(7)
    made = ["".join(rng.choice("abcdeABC é ß.!?,\n\t'-[]") for _ in range(rng.randint(0, 200))) for _ in range(200)]
    return spark.createDataFrame([(i, t) for i, t in enumerate(ODD + made + [None])], "id int, t string")


def _same(df, a, b):
    for r in df.select("t", a.alias("a"), b.alias("b")).collect():
        assert r["a"] == r["b"], r["t"]


def test_passes_say_what_the_expressions_say(texts):
    t = F.col("t")
    base = F.array(F.lit("base"), F.lit("word"))
    phrases = ("the of", "a", "B c", ". [")
    for a, b in ((passes.normal_and_words(t)["normal"], X.normalise(t)), (passes.normal_and_words(t)["words"], X.word_count(t)),
                 (passes.word_count(t), X.word_count(t)), (passes.keywords(t, base), X.keywords(t, base)),
                 (passes.search_phrase(t, ("word", "tabs")), X.search_phrase(t, ("word", "tabs"))), (passes.visual_hint(t), X.visual_hint(t)),
                 (passes.title_case(t), X.title_case(t)), (passes.drop_phrases(t, phrases), X.drop_phrases(t, phrases)),
                 (passes.sections(t), X.sections(t)),
                 (passes.extract_sentences(t, 5, 3), X.extract_sentences(t, 5, 3)), (passes.extract_sentences(t), X.extract_sentences(t)), (X.overlay(t), _overlay(t)), (X.headline(t), _headline(t))):
        _same(texts, a, b)


def _overlay(c, limit=8):
    w = X.words(c)
    return F.concat(F.array_join(F.slice(w, 1, limit), " "), F.when(F.size(w) > limit, F.lit("…")).otherwise(F.lit("")))


def _headline(c):
    return F.upper(F.array_join(F.slice(X.words(c), 1, 6), " "))


def test_story_counts(texts):
    beats, emotion = (("a", "the"), ("zz",), ("c",)), ("a", "the", "b'c")
    low = F.lower("t")
    tokens = F.regexp_extract_all(low, F.lit("[a-z']+"), F.lit(0))
    sizes = F.transform(X.clauses(F.col("t")), X.word_count)
    add = lambda f: F.aggregate(sizes, F.lit(0).cast("bigint"), lambda acc, x: acc + f(x))
    want = F.struct(
        sum(X.contains_any(F.col("t"), g).cast("bigint") for g in beats), F.size(tokens).cast("bigint"),
        F.size(F.filter(tokens, lambda w: w.isin(*emotion))).cast("bigint"), F.size(sizes).cast("bigint"), add(lambda x: x), add(lambda x: x * x))
    for r in texts.filter("t is not null").select("t", passes.story_counts(F.col("t"), beats, emotion).alias("a"), want.alias("b")).collect():
        assert tuple(r["a"]) == tuple(r["b"]), r["t"]


def test_scenes_rescaled_and_cues(texts):
    rules = P.SceneRules()
    t = F.col("t")
    got = texts.select("id", "t", passes.scenes(t, 155, rules.min_seconds, rules.max_seconds).alias("s"))
    spoken = lambda s: F.least(F.lit(6.0), F.greatest(F.lit(2.5), X.reading_seconds(X.word_count(s))))
    want = F.transform(X.sentences(t), lambda s, i: F.struct(i.alias("idx"), s.alias("narration"), spoken(s).alias("duration")))
    for r in got.withColumn("w", want).collect():
        assert r["s"] == r["w"], r["t"]
    # against the forms that work on scene rows
    rows = got.filter("t is not null").select(F.col("id").alias("run_id"), "s", (F.col("id") * 1.37).alias("narration_seconds"))
    flat = rows.select("run_id", F.explode("s").alias("s")).select("run_id", "s.*")
    stretched = rows.withColumn("s", passes.rescaled(F.col("s"), F.col("narration_seconds"), 0.8, 1.0))
    left = stretched.select("run_id", F.explode("s").alias("s")).select("run_id", "s.idx", "s.duration")
    assert sorted(map(tuple, left.collect())) == sorted(map(tuple, timeline.rescale(flat, rows).select("run_id", "idx", "duration").collect()))
    gaps = F.transform("s", lambda s: F.struct(s["idx"].alias("idx"), F.when(s["idx"] % 3 == 1, "  ").otherwise(s["narration"]).alias("narration"), s["duration"].alias("duration")))
    blanked = stretched.withColumn("scenes", gaps)
    cues = timeline.caption_rows(blanked.select("run_id", "scenes"))
    slow = timeline.caption_cues(blanked.select("run_id", F.explode("scenes").alias("s")).select("run_id", "s.*"))
    assert sorted(map(tuple, cues.collect())) == sorted(map(tuple, slow.select(*cues.columns).collect()))
    totals = timeline.totals_in_row(rows.withColumnRenamed("s", "scenes"))
    assert sorted(map(tuple, totals.collect())) == sorted(map(tuple, timeline.plan_totals(flat).select(*totals.columns).collect()))


def test_half_up_on_printed_digits():
    r = np.random.default_rng(3)
    x = np.concatenate([r.uniform(0, 100, 2000), np.round(r.uniform(0, 100, 500), 3), [0.005, 1.005, 2.675, 1.115, 0.0, 33.335]])
    want = [int(Decimal(repr(float(v))).quantize(Decimal("0.01"), ROUND_HALF_UP) * 100) for v in x]
    assert passes.half_up(x).tolist() == want
