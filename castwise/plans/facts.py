"""Fact dossiers: verdicts, the gate, roll-ups and the claim block of a prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castwise import params as P
from castwise.functions import passes, scores, text
from castwise.operators.joins import lookup
from castwise.operators.ranking import fill_if_short, top_per_group


def verdicts(facts: DataFrame, rules: P.FactRules = P.FactRules()) -> DataFrame:
    """Confidence after license bonus and source penalty, with a status. The status uses the unrounded value."""
    source = F.coalesce(F.col("source_name"), F.lit(""))
    unsourced = (source == "") | F.contains(F.lower(source), F.lit("unverified"))
    raw = (
        F.col("confidence").cast("double")
        + lookup({k: float(v) for k, v in rules.license_bonus.items()}, F.col("license"), 0.0)
        - F.when(unsourced, float(rules.unsourced_penalty)).otherwise(0.0)
    )
    checked = facts.withColumn("__score", scores.clamp(raw))
    return (
        checked.withColumn("status", scores.fact_status(F.col("__score"), rules.approve_at, rules.verify_at))
        .withColumn("checked_confidence", F.round("__score", 1))
        .withColumn("note", F.concat(
            F.lit("source="), text.or_else(F.col("source_name"), F.lit("none")), F.lit(", license="), F.col("license")))
        .drop("__score")
    )


def usable() -> Column:
    return F.col("status").isin("approved", "needs_verification")


def gate(checked: DataFrame, dossiers: DataFrame | None = None, rules: P.FactRules = P.FactRules()) -> DataFrame:
    """Per dossier: facts, usable ones, mean confidence, fact score and whether the gate is passed.

    With ``dossiers`` given, those without any fact appear too and fail the gate.
    """
    conf = F.col("checked_confidence").cast("decimal(18,4)")
    sums = checked.groupBy("dossier_id").agg(
        F.count("*").alias("facts"),
        F.count_if(usable()).alias("usable"),
        F.sum(conf).cast("double").alias("__all"),
        F.sum(F.when(usable(), conf)).cast("double").alias("__usable"),
    )
    if dossiers is not None:
        sums = dossiers.select("dossier_id").join(sums, "dossier_id", "left").fillna(0)
    coverage = F.col("usable") / F.col("facts") * 100
    mean_usable = F.coalesce(F.try_divide("__usable", "usable"), F.lit(0.0))
    return sums.select(
        "dossier_id", "facts", "usable",
        F.round(F.coalesce("__all", F.lit(0.0)) / F.greatest(F.lit(1), "facts"), 1).alias("avg_confidence"),
        F.when(F.col("facts") > 0, F.round(F.lit(0.5) * mean_usable + F.lit(0.5) * coverage, 1))
        .otherwise(0.0).alias("fact_score"),
        (F.col("usable") >= rules.min_usable).alias("gate_passed"),
    )


def dossier_rollup(facts: DataFrame, order: list[Column], per_kind: int = 5) -> DataFrame:
    """Mean confidence and the first people, events and statistics of every dossier."""
    overall = facts.groupBy("dossier_id").agg(
        F.count("*").alias("facts"),
        F.round(F.sum(F.col("confidence").cast("decimal(18,4)")).cast("double") / F.count("*"), 1)
        .alias("overall_confidence"),
    )
    listed = facts.filter(F.col("information_type").isin("person", "event", "stat"))
    few = top_per_group(listed, ["dossier_id", "information_type"], order, per_kind, rank="n")

    def first(kind: str, value: str) -> Column:
        rows = F.collect_list(F.when(F.col("information_type") == kind, F.struct("n", F.col(value).alias("v"))))
        return F.transform(F.array_sort(rows), lambda r: r["v"])

    lists = few.groupBy("dossier_id").agg(
        first("person", "detail").alias("people"),
        first("event", "claim").alias("events"),
        first("stat", "claim").alias("statistics"),
    )
    none = F.array().cast("array<string>")
    return overall.join(lists, "dossier_id", "left").select(
        "dossier_id", "facts", "overall_confidence",
        *[F.coalesce(F.col(c), none).alias(c) for c in ("people", "events", "statistics")],
    )


def claim_block(facts: DataFrame, dossiers: DataFrame, order: list[Column], limit: int = 8, default: str = "") -> DataFrame:
    """``- claim`` lines of the first facts per dossier; ``default`` where a dossier has none."""
    few = top_per_group(facts, ["dossier_id"], order, limit, rank="n")
    lines = few.groupBy("dossier_id").agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "claim"))), lambda r: F.concat(F.lit("- "), r["claim"])), "\n"
    ).alias("lines"))
    return dossiers.select("dossier_id").distinct().join(lines, "dossier_id", "left").select(
        "dossier_id", F.coalesce("lines", F.lit(default)).alias("lines")
    )


def facts_from_extracts(extracts: DataFrame, key: str, body: str, source: str, license: str, confidence: float) -> DataFrame:
    """Encyclopedia extracts as fact rows: the first long enough sentences."""
    return extracts.select(
        F.col(key).alias("dossier_id"),
        F.posexplode_outer(passes.extract_sentences(F.col(body))).alias("pos", "claim"),
    ).filter(F.col("pos").isNotNull()).select(
        "dossier_id", "pos", "claim", F.col("claim").alias("detail"), F.lit(source).alias("source_name"),
        F.lit("fact").alias("information_type"), F.lit(license).alias("license"), F.lit(float(confidence)).alias("confidence"),
    )


def facts_from_notes(notes: DataFrame, key: str, body: str, limit: int = 5, confidence: float = 85.0) -> DataFrame:
    """General-knowledge facts out of bullet notes; the kind cycles by line, the first ``limit`` lines count."""
    kinds = F.array(*[F.lit(k) for k in P.FACT_KINDS])
    lines = F.filter(F.split(body, r"\r\n|\r|\n"), lambda x: text.strip(x) != "")
    bare = F.transform(lines, lambda x: text.strip(F.btrim(x, F.lit("-• "))))
    return notes.select(F.col(key).alias("dossier_id"), F.posexplode_outer(F.slice(bare, 1, limit)).alias("pos", "claim")).filter(
        F.col("pos").isNotNull()
    ).select(
        "dossier_id", "pos", "claim", F.col("claim").alias("detail"), F.lit("General knowledge").alias("source_name"),
        F.element_at(kinds, F.pmod("pos", F.lit(len(P.FACT_KINDS))) + 1).alias("information_type"),
        F.lit("general-knowledge").alias("license"), F.lit(float(confidence)).alias("confidence"),
    )


def dossier_facts(from_sources: DataFrame, from_notes: DataFrame, minimum: int = 5) -> DataFrame:
    """Sourced facts, and the notes as well for dossiers with fewer than ``minimum`` of them."""
    return fill_if_short(from_sources, from_notes, ["dossier_id"], minimum)


def allowed_license(license: Column) -> Column:
    """False only for a stated license that is not public domain or Creative Commons (any case, anywhere in it)."""
    lic = F.coalesce(license, F.lit(""))
    return (lic == "") | lic.rlike("(?i)public domain|cc|pd")
