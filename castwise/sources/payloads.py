"""Landed API responses (one JSON text per row) as flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castwise import schemas
from castwise.functions import text
from castwise.plans.facts import allowed_license


def posts(payloads: DataFrame, key: str, body: str) -> DataFrame:
    """Posts of a listing: title and votes, with their position."""
    parsed = F.from_json(body, schemas.POST_LISTING)
    return payloads.select(key, F.posexplode(parsed["data"]["children"]).alias("position", "child")).select(
        key, "position",
        F.coalesce(F.col("child.data.title"), F.lit("")).alias("title"),
        F.coalesce(F.col("child.data.ups"), F.lit(0)).alias("ups"),
    )


def media_files(payloads: DataFrame, key: str, body: str) -> DataFrame:
    """Files of a page map: usable address, title, license, credit. Files without address or free license go."""
    pages = F.map_values(F.from_json(body, schemas.FILE_LISTING)["query"]["pages"])
    rows = payloads.select(key, F.posexplode(pages).alias("position", "page"))
    info = F.try_element_at(F.col("page.imageinfo"), F.lit(1))
    license = F.coalesce(info["extmetadata"]["LicenseShortName"]["value"], F.lit(""))
    artist = F.coalesce(info["extmetadata"]["Artist"]["value"], F.lit(""))
    return rows.select(
        key, "position",
        text.or_else(info["thumburl"], info["url"]).alias("url"),
        F.replace(F.coalesce("page.title", F.lit("")), F.lit("File:"), F.lit("")).alias("title"),
        license.alias("raw_license"),
        F.left(text.strip_tags(artist), F.lit(120)).alias("credit"),
        F.lit("Wikimedia Commons").alias("source"),
    ).filter(text.present(F.col("url")) & allowed_license(F.col("raw_license"))).select(
        key, "position", "url", "title", text.or_else(F.col("raw_license"), F.lit("see Commons")).alias("license"),
        "credit", "source",
    )


def image_results(payloads: DataFrame, key: str, body: str, query: Column) -> DataFrame:
    """Image search results with defaults for missing title, license, creator and source."""
    rows = payloads.select(
        key, query.alias("query"), F.posexplode(F.from_json(body, schemas.IMAGE_LISTING)["results"]).alias("position", "r")
    )
    return rows.filter(text.present(F.col("r.url"))).select(
        key, "position", F.col("r.url").alias("url"),
        text.or_else(F.col("r.title"), F.col("query")).alias("title"),
        F.upper(text.or_else(F.col("r.license"), F.lit("cc"))).alias("license"),
        F.coalesce("r.creator", F.lit("")).alias("credit"),
        text.or_else(F.col("r.source"), F.lit("Openverse")).alias("source"),
    )


def json_field(body: Column, path: str) -> Column:
    return F.get_json_object(body, path)
