import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from castwise import params as P
from castwise.functions import clock
from castwise.functions import text as X


def ev(spark, value, fn, type_="string"):
    return spark.createDataFrame([(value,)], f"v {type_}").select(fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("raw, clean", [
    ('Hook 8: "Revealed: the hidden reason."', "Revealed: the hidden reason."),
    ("- 3) The Secret of Rome", "The Secret of Rome"),
    ('"A quoted hook"', "A quoted hook"),
    ("  • hook - why  ", "why"),
    ("HOOK2.  'x'", "x"),
])
def test_clean_hook(spark, raw, clean):
    assert ev(spark, raw, X.clean_hook) == clean


@pytest.mark.parametrize("raw, clean", [('2. "The Untold Story"', "The Untold Story"), ("The Fall of Rome", "The Fall of Rome"),
                                        ("Hook 1: kept", "Hook 1: kept")])
def test_clean_title(spark, raw, clean):
    assert ev(spark, raw, X.clean_title) == clean


def test_counts_and_reading_time(spark):
    assert ev(spark, " a  b\nc ", X.word_count) == 3
    assert ev(spark, "", X.word_count) == 0
    assert ev(spark, 0, X.reading_seconds, "int") == 0.39
    assert ev(spark, 155, X.reading_seconds, "int") == 60.0
    assert ev(spark, "", lambda c: X.or_else(c, F.lit("b"))) == "b"
    assert ev(spark, None, lambda c: X.or_else(c, F.lit("b"))) == "b"


def test_sentences(spark):
    assert ev(spark, "[HOOK] One here. Two there!  No. Is it? [CHAPTER: x] end", X.sentences) == [
        "One here.", "Two there!", "Is it?", "[CHAPTER: x] end"]
    assert ev(spark, "", X.sentences) == []
    assert ev(spark, "a. b!? ... c", X.clauses) == ["a", " b", " c"]


def test_sections(spark):
    out = ev(spark, "[HOOK] a [BODY]b [x] c\n[HOOK] last ", X.sections)
    assert out == {"HOOK": "last", "BODY": "b [x] c"}
    assert ev(spark, " plain ", X.sections) == {"BODY": "plain"}


def test_title_case(spark):
    assert ev(spark, "don't STOP the 2nd-best", X.title_case) == "don't STOP the 2nd-best".title()


def test_fit_overlay_hint(spark):
    assert ev(spark, "abcdef", lambda c: X.fit(c, 6)) == "abcdef"
    assert ev(spark, "abcd ef", lambda c: X.fit(c, 6)) == "abcd…"
    assert ev(spark, "1 2 3 4 5 6 7 8", X.overlay) == "1 2 3 4 5 6 7 8"
    assert ev(spark, "1 2 3 4 5 6 7 8 9", X.overlay) == "1 2 3 4 5 6 7 8…"
    assert ev(spark, "a bb cc", X.visual_hint) == "abstract concept"
    assert ev(spark, "The Empires quietly fell", X.visual_hint) == "Empires, quietly"


def test_keywords_and_search_phrase(spark):
    base = F.array(F.lit("history"), *[F.lit(w) for w in P.KEYWORD_BASE])
    assert ev(spark, "The Story of Rome's story", lambda c: X.keywords(c, base)) == [
        "story", "rome", "history", "documentary", "education", "facts", "explained"]
    phrase = lambda c: X.search_phrase(c, P.SEARCH_STOP_WORDS, 3)
    assert ev(spark, "Why the Secret Reason Rome Collapsed, Rome's empire rome fell", phrase) == "rome collapsed rome's"
    assert ev(spark, None, phrase) == ""


def test_drop_phrases(spark):
    raw = "In Conclusion, we DELVE INTO it.\n\n\n\nEnd"
    assert ev(spark, raw, lambda c: X.drop_phrases(c, P.BANNED_PHRASES)) == ", we  it.\n\nEnd"


@pytest.mark.parametrize("reply, value", [
    ('Sure\n```json\n{"a": [1, 2]}\n```', {"a": [1, 2]}), ("  [1, 2] ", [1, 2]), ('so {"a": 1} it is', {"a": 1}),
    ("no json", None), ("{broken", None), ("", None),
])
def test_json_in_reply(spark, reply, value):
    found = ev(spark, reply, X.json_in_reply)
    assert (json.loads(found) if found is not None else None) == value


def test_prompts(spark):
    assert ev(spark, "fear", lambda c: X.fill_template("TASK: hooks {topic} {x}", {"topic": c})) == "TASK: hooks fear {x}"
    assert ev(spark, "x", lambda c: X.marked_prompt("t", {"topic": c})) == "TASK: t\nTOPIC: x"


@pytest.mark.parametrize("day", ["2023-01-01", "2024-01-01", "2024-12-31", "2026-01-04", "2026-01-05", "2027-01-03"])
def test_week_label(spark, day):
    d = dt.date.fromisoformat(day)
    assert ev(spark, d, clock.week_label, "date") == d.strftime("%Y-W%W")


@pytest.mark.parametrize("s, label", [(0.0, "00:00:00,000"), (3.0, "00:00:03,000"), (-1.0, "00:00:00,000"), (3725.55, "01:02:05,550")])
def test_srt_time(spark, s, label):
    assert ev(spark, s, lambda c: clock.srt_time(c.cast("decimal(18,2)")), "double") == label


def test_extract_sentences(spark):
    body = "Short. " + ". ".join(f"This sentence number {i} is long enough" for i in range(9))
    out = ev(spark, body, X.extract_sentences)
    assert len(out) == 6 and out[0] == "This sentence number 0 is long enough"
