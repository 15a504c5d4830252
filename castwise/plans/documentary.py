"""Long-form scripts: chapters and assembly; short scripts out of sectioned replies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castwise import params as P
from castwise.functions import passes, text
from castwise.operators.ranking import first_occurrence, top_per_group

SECTIONS = ("HOOK", "INTRODUCTION", "BODY", "ENDING", "CTA")


def chapters(content: DataFrame, categories: DataFrame | None = None, minimum: int = 4, maximum: int = 6, sample: int = 10,
             arc: Sequence[str] = P.DEFAULT_ARC) -> DataFrame:
    """Chapter names per category: its produced topics if there are enough distinct ones, else the default arc.

    The first ``sample`` content rows of the category by id are looked at. ``categories`` names those that
    are asked for (default: those with content); one without any content has the default arc.
    """
    few = top_per_group(content.select("category", "id", "topic"), ["category"], [F.col("id")], sample)
    names = first_occurrence(few, F.trim(F.lower("topic")), [F.col("id")], within=["category"])
    related = top_per_group(
        names.select("category", "id", text.title_case(F.col("topic")).alias("chapter")),
        ["category"], [F.col("id")], sample, rank="n",
    )
    # at most ``sample`` names per category from here on
    asked = few if categories is None else categories
    lists = asked.select("category").distinct().join(
        related.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("n", "chapter"))).alias("r")),
        "category", "left",
    )
    own = F.transform(F.coalesce("r", F.array().cast("array<struct<n:int,chapter:string>>")), lambda x: x["chapter"])
    fallback = F.array(*[F.lit(a) for a in arc])
    first = F.slice(F.when(F.size(own) >= minimum, own).otherwise(fallback), 1, maximum)
    chosen = F.when(F.size(first) >= minimum, first).otherwise(F.slice(F.concat(first, fallback), 1, maximum))
    return lists.select("category", F.posexplode(chosen).alias("chapter_no", "chapter"))


def assemble(documentaries: DataFrame, cta: str) -> DataFrame:
    """Full script of (id, topic, hook, chapters array<struct<name, body>>): introduction, chapters, conclusion, CTA.

    The chapters of a documentary are a short list held in its row.
    """
    lead = F.when(text.present(F.col("hook")), F.concat("hook", F.lit("\n\n"))).otherwise(F.lit(""))
    intro = F.concat(lead, text.fill_template(P.INTRO_TEXT, {"topic": F.col("topic")}))
    ending = text.fill_template(P.ENDING_TEXT, {"topic": F.col("topic")})
    blocks = F.transform("chapters", lambda c: F.concat(F.lit("[CHAPTER: "), c["name"], F.lit("]\n"), c["body"]))
    full = F.array_join(F.concat(
        F.array(F.concat(F.lit("[INTRODUCTION]\n"), intro)), blocks,
        F.array(F.concat(F.lit("[CONCLUSION]\n"), ending), F.lit(f"[CTA]\n{cta}")),
    ), "\n\n")
    return documentaries.select(
        "id", intro.alias("introduction"), F.array_join(blocks, "\n\n").alias("body"), ending.alias("ending"),
        full.alias("full_text"), passes.word_count(full).alias("word_count"),
        F.concat(F.lit("documentary-"), F.size("chapters").cast("string"), F.lit("-chapters")).alias("structure"),
    )


def scripts(items: DataFrame, chapters: DataFrame, bodies: DataFrame, cta: str) -> DataFrame:
    """Full scripts (as ``assemble``) of items (id, category, topic, hook) over the chapters derived for their category.

    ``chapters`` is what ``chapters`` gives; ``bodies`` (id, chapter_no, body) has one row per written chapter. A
    chapter nobody wrote keeps its heading; an item without a category has none; bodies of unknown items or chapters are left out.
    """
    named = chapters.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("chapter_no", "chapter"))).alias("names"))
    known = items.select("id", "category").join(chapters, "category").join(bodies, ["id", "chapter_no"])
    # an item has at most as many bodies as its category has chapters, a few
    written = known.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("chapter_no", "body"))).alias("bodies"))
    rows = items.join(named, "category", "left").join(written, "id", "left")
    names = F.coalesce("names", F.array().cast("array<struct<chapter_no:int,chapter:string>>"))
    filled = F.transform(names, lambda c: F.struct(
        c["chapter"].alias("name"), F.coalesce(F.try_element_at("bodies", c["chapter_no"]), F.lit("")).alias("body")))
    return assemble(rows.select("id", "topic", "hook", filled.alias("chapters")), cta)


def script_from_reply(replies: DataFrame, hook: str | None = None, banned: Sequence[str] = P.BANNED_PHRASES,
                      cta: str = "") -> DataFrame:
    """Sections of (id, reply), cleaned of banned phrases, and the joined script. A given hook column leads it."""
    parsed = replies.withColumn("__s", passes.sections(F.col("reply")))
    cells = {}
    for name in SECTIONS:
        found = F.try_element_at("__s", F.lit(name))
        if name == "HOOK" and hook:
            found = text.or_else(F.col(hook), found)
        cells[name] = passes.drop_phrases(F.coalesce(found, F.lit("")), banned)
    parts = parsed.select("id", *[c.alias(n.lower()) for n, c in cells.items()],
                          F.map_contains_key("__s", "CTA").alias("__has_cta"))
    full = text.join_present([F.col(n.lower()) for n in SECTIONS])
    return parts.withColumn("full_text", full).withColumn("word_count", passes.word_count(F.col("full_text"))).withColumn(
        "cta", F.when(F.col("__has_cta"), F.col("cta")).otherwise(F.lit(cta))
    ).drop("__has_cta")
