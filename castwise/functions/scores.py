"""Score expressions for hooks, titles, topics, scripts and bands."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from castwise import params as P
from castwise.functions import passes
from castwise.functions import text as X


def exact(c: Column) -> Column:
    """A score by its printed digits, so that weighted sums have no binary noise and ties round half up."""
    return c.cast("decimal(14,6)")


def weight(value: float) -> Column:
    return F.lit(Decimal(str(value)))


def rounded(c: Column, digits: int = 1) -> Column:
    return F.round(c, digits).cast("double")


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def band(c: Column, steps: Iterable[tuple[float, str]], otherwise: str) -> Column:
    """The name of the first step whose bound ``c`` reaches (``>=``)."""
    out = None
    for bound, name in steps:
        out = F.when(c >= bound, F.lit(name)) if out is None else out.when(c >= bound, F.lit(name))
    return out.otherwise(F.lit(otherwise))


def fact_status(c: Column, approve_at: float = 90, verify_at: float = 70) -> Column:
    return band(c, [(approve_at, "approved"), (verify_at, "needs_verification")], "rejected")


def risk_band(c: Column) -> Column:
    return F.when(c < 34, "low").when(c < 67, "medium").otherwise("high")


def duration_bucket(seconds: Column) -> Column:
    s = F.coalesce(seconds, F.lit(0))
    return F.when(s <= 30, "0-30s").when(s <= 60, "30-60s").when(s <= 90, "60-90s").otherwise("90s+")


def outcome(avg: Column, worked_at: float = 60) -> Column:
    return F.when(avg >= worked_at, "worked").otherwise("failed")


def interest_band(ups: Column) -> Column:
    return F.when(ups > 5000, "high").otherwise("medium")


def trend_score(ups: Column) -> Column:
    return F.least(F.lit(100.0), F.lit(40.0) + ups / F.lit(500.0))


def hook_dimensions(
    text: Column,
    signals: Mapping[str, Iterable[str]] = P.HOOK_SIGNALS,
    bases: Mapping[str, int] = P.HOOK_BASES,
) -> dict[str, Column]:
    dims = {
        name: F.least(F.lit(100), F.lit(bases[name]) + X.count_markers(text, signals.get(name, ())) * 12)
        for name in ("curiosity", "emotion", "shock", "novelty")
    }
    dims["clarity"] = F.greatest(F.lit(40), F.lit(100) - F.abs(X.word_count(text) - 12) * 4)
    return dims


def hook_total(dims: Mapping[str, Column]) -> Column:
    """Weighted mean of the three strongest dimensions."""
    ranked = F.sort_array(F.array(*dims.values()), asc=False)
    weights = (1.2, 1.0, 0.8)
    total = sum(weight(w) * exact(F.element_at(ranked, i + 1)) for i, w in enumerate(weights))
    return rounded(total / weight(sum(Decimal(str(w)) for w in weights)))


def hook_type(dims: Mapping[str, Column]) -> Column:
    best_other = F.greatest(dims["emotion"], dims["shock"], dims["novelty"])
    return F.when(dims["curiosity"] >= best_other, "curiosity").otherwise("emotion")


def title_score(title: Column, markers: Iterable[str] = P.TITLE_MARKERS) -> Column:
    return X.count_markers(title, markers) * 10 - F.abs(F.length(title) - 55) * F.lit(0.2)


def topic_total(d: Mapping[str, Column], w: P.TopicWeights = P.TopicWeights()) -> Column:
    raw = (
        weight(w.virality) * exact(d["virality"])
        + weight(w.curiosity) * exact(F.least(F.lit(100), d["curiosity"]))
        + weight(w.evergreen) * exact(d["evergreen"])
        + weight(w.educational) * exact(d["educational"])
        + weight(w.emotional) * exact(d["emotional"])
        - weight(w.competition) * exact(d["competition"])
    )
    return rounded(raw / F.lit(Decimal(5)))


def topic_curiosity(angle: Column, signal: Column, markers: Iterable[str] = P.CURIOSITY_MARKERS) -> Column:
    """Base 70, a bonus for a curiosity marker in the angle, and the measured signal."""
    return F.lit(70) + F.when(X.contains_any(angle, markers), 12).otherwise(0) + signal


def gap(demand: Column, coverage: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), (demand - coverage) / F.lit(100.0)), 2)


def storytelling(
    text: Column,
    structured: Column,
    beats: Mapping[str, Iterable[str]] = P.BEAT_MARKERS,
    emotion_words: Iterable[str] = P.EMOTION_WORDS,
) -> Column:
    """Narrative beats, emotive words, sentence-length variety and structure; blank text scores 0."""
    found = passes.story_counts(text, beats.values(), emotion_words)
    beat_part = found["beats"] / F.lit(float(len(beats))) * 100
    emotion_part = F.least(F.lit(100.0), found["hits"] / F.greatest(F.lit(1), found["tokens"]) * 4000)
    total = (
        weight(0.4) * exact(beat_part) + weight(0.25) * exact(emotion_part)
        + weight(0.15) * exact(_variety(*(found[c].cast("double") for c in ("clauses", "words", "squares"))))
        + weight(0.2) * F.when(structured, 100).otherwise(60)
    )
    return F.when(X.present(text), rounded(total)).otherwise(F.lit(0.0))


def structured(introduction: Column, ending: Column) -> Column:
    """A script has structure if it has an introduction and an ending."""
    return X.present(X.strip(introduction)) & X.present(X.strip(ending))


def _variety(n: Column, total: Column, squares: Column) -> Column:
    """Spread of sentence lengths against their mean (population form); 40 for two sentences or fewer."""
    # n * sum(x^2) - sum(x)^2 is exact on whole numbers, so no digit is lost before the root
    deviation = F.sqrt(n * squares - total * total) / n
    return F.when(n > 2, F.least(F.lit(100.0), deviation / F.greatest(F.lit(1.0), total / n) * 200)).otherwise(40.0)


def retention_prediction(
    hook_score: Column,
    story_score: Column,
    opener: Column,
    avg_scene_seconds: Column,
    seconds: Column,
    low: Column,
    high: Column,
    markers: Iterable[str] = P.OPENER_MARKERS,
) -> Column:
    """Hook and story strength, corrected by opener, cutting pace and length on target. NULL inputs add nothing."""
    curious = F.coalesce(F.contains(opener, F.lit("?")) | X.contains_any(opener, markers), F.lit(False))
    pace = F.when(avg_scene_seconds <= 5.5, 6).when(avg_scene_seconds > 8, -6).otherwise(0)
    known = seconds.isNotNull() & (seconds != 0)
    on_target = F.when(known & seconds.between(low, high), 6).when(known, -6).otherwise(0)
    raw = weight(0.45) * exact(hook_score) + weight(0.25) * exact(story_score) + F.when(curious, 8).otherwise(0) + pace + on_target
    return rounded(F.least(F.lit(Decimal(100)), F.greatest(F.lit(Decimal(0)), raw)))


def copyright_risk(background_music: bool, user_tracks: Column) -> Column:
    risk = F.lit(5.0)
    if background_music:
        risk = risk + F.when(user_tracks, 12.0).otherwise(1.0)
    return F.round(F.least(F.lit(100.0), risk), 1)
