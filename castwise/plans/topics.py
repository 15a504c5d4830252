"""Topic candidates: expansion, scoring, duplicate gate, gaps and trends."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castwise import params as P
from castwise.functions import scores, text
from castwise.operators.joins import lookup
from castwise.operators.ranking import first_occurrence, top_per_group
from castwise.operators.similarity import closest_short_text
from castwise.session import staged

DIMENSIONS = ("virality", "curiosity", "evergreen", "educational", "emotional", "competition")


def corpus(content: DataFrame, topics: DataFrame) -> DataFrame:
    """Texts a new topic must differ from: every produced topic, and the used or approved backlog."""
    used = topics.filter(F.col("status").isin("used", "approved")).select(
        text.or_else(F.col("angle"), F.col("topic")).alias("topic")
    )
    return content.select("topic").unionByName(used).filter(text.present(F.col("topic")))


def candidate_phrases(
    trends: DataFrame,
    taxonomy: Mapping[str, Sequence[str]] = P.SUBCATEGORIES,
    limit: int = 40,
    leads: Mapping[str, str] = P.TOPIC_LEADS,
    default_lead: str = P.DEFAULT_TOPIC_LEAD,
) -> DataFrame:
    """Trend phrases, then every sub-category of the category and a phrase built on it; distinct, capped.

    ``trends`` has (category, topic, position). The taxonomy rows of a category are
    attached to the categories that occur, so the result has rows for those only.
    """
    seeds = F.create_map(*[x for c, subs in taxonomy.items() for x in (F.lit(c), F.array(*[F.lit(s) for s in subs]))])
    lead = lookup(leads, F.col("category"), default_lead)
    from_trends = trends.select(
        "category", F.col("topic").alias("phrase"), F.col("category").alias("subcategory"),
        F.lit(0).alias("source"), F.col("position").cast("long").alias("position"),
    )
    from_taxonomy = (
        trends.select("category").distinct()
        .select("category", F.posexplode(F.coalesce(
            F.try_element_at(seeds, F.col("category")), F.array(F.lit("human nature")))).alias("i", "sub"))
        .select("category", F.col("sub").alias("subcategory"), F.lit(1).alias("source"),
                F.posexplode(F.array(F.col("sub"), F.concat(lead, "sub"))).alias("j", "phrase"), "i")
        .withColumn("position", (F.col("i") * 2 + F.col("j")).cast("long"))
        .drop("i", "j")
    )
    key = F.trim(F.lower("phrase"))
    # equal phrases of one position differ only in case, so the text settles the order
    order = [F.col("source"), F.col("position"), F.col("phrase")]
    distinct = first_occurrence(from_trends.unionByName(from_taxonomy), key, order, within=["category"])
    return top_per_group(distinct, ["category"], order, limit, rank="candidate")


def scored(topics: DataFrame, weights: P.TopicWeights = P.TopicWeights()) -> DataFrame:
    """Topic rows with ``total`` from their measured dimensions."""
    return topics.withColumn("total", scores.topic_total({d: F.col(d) for d in DIMENSIONS}, weights))


def judged(topics: DataFrame, markers: Iterable[str] = P.CURIOSITY_MARKERS) -> DataFrame:
    """Topic rows with ``curiosity`` worked out from ``angle`` and the measured ``signal`` (NULL counts as 0), at most 100.

    ``scored`` and ``opportunities`` take the result; a curiosity column the rows may have is replaced.
    """
    found = scores.topic_curiosity(F.coalesce("angle", F.lit("")), F.coalesce("signal", F.lit(0)), markers)
    return topics.withColumn("curiosity", F.least(F.lit(100), found))


def opportunities(
    topics: DataFrame,
    existing: DataFrame,
    top_k: int = 6,
    min_total: float = 40,
    threshold: float = P.DUPLICATE_THRESHOLD,
    weights: P.TopicWeights = P.TopicWeights(),
) -> DataFrame:
    """The ``top_k`` topics per category, checked against the corpus; duplicates lose 100 points.

    The cheap score picks the few candidates first, so the text comparison runs on
    them and not on the whole backlog. ``selected`` marks the best one per category
    that reaches ``min_total``.
    """
    cheap = scored(topics, weights)
    few = staged(
        top_per_group(cheap, ["category"], [F.col("total").desc(), F.col("topic_id")], top_k)
        .select("topic_id", "category", "angle", "total"),
        "topic-candidates",
    )
    checked = closest_short_text(few, existing, "topic_id", "angle", "topic", threshold)
    final = staged(few.join(checked, "topic_id").select(
        "topic_id", "category", "angle",
        F.round(F.col("max_similarity") * 100, 1).alias("duplicate"),
        F.round(F.col("total") - F.when(F.col("is_duplicate"), 100).otherwise(0), 1).alias("total"),
    ), "checked-topics")
    # at most ``top_k`` rows per category are left here
    best = top_per_group(
        final.filter(F.col("total") >= min_total), ["category"], [F.col("total").desc(), F.col("topic_id")], 1
    ).select("topic_id", F.lit(True).alias("selected"))
    return final.join(best, "topic_id", "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


def opportunity_gap(topics: DataFrame, threshold: float = 0.6, k: int = 8) -> DataFrame:
    """Demand not met by existing coverage: gaps of at least 0.4 x threshold, the widest ``k`` per category."""
    wide = topics.withColumn("gap", scores.gap(F.col("demand"), F.col("coverage"))).filter(
        F.col("gap") >= threshold * 0.4
    )
    best = top_per_group(wide, ["category"], [F.col("gap").desc(), F.col("topic_id")], k, rank="position")
    return best.select(
        "topic_id", "category", "demand", "coverage",
        F.round(F.col("gap") * 100, 1).alias("opportunity_score"), "position",
    )


def trend_items(posts: DataFrame, per_category: int = 12) -> DataFrame:
    """Trend score and interest band of landed posts (category, title, ups), the strongest per category."""
    items = posts.select(
        "post_id", "category", F.left("title", F.lit(180)).alias("topic"), "ups",
        scores.trend_score(F.col("ups")).alias("trend_score"),
        scores.interest_band(F.col("ups")).alias("estimated_interest"),
    )
    return top_per_group(items, ["category"], [F.col("trend_score").desc(), F.col("post_id")], per_category, rank="position")
