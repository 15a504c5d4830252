"""Text expressions. Every function takes and returns columns; all stay on the JVM side."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"^\s+|\s+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, BLANKS, "")


def normalise(c: Column) -> Column:
    """Lower case, every whitespace run one space, no outer blanks."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\S+"))


def reading_seconds(n_words: Column, wpm: int = 155) -> Column:
    return F.round(F.greatest(F.lit(1), n_words) / F.lit(float(max(1, wpm))) * 60.0, 2)


def or_else(c: Column, fallback: Column) -> Column:
    """``c`` unless it is NULL or the empty string."""
    return F.coalesce(F.nullif(c, F.lit("")), fallback)


def present(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def contains_any(c: Column, markers: Iterable[str]) -> Column:
    low = F.lower(c)
    found = F.lit(False)
    for marker in markers:
        found = found | F.contains(low, F.lit(marker))
    return found


def count_markers(c: Column, markers: Iterable[str]) -> Column:
    """How many of the markers occur (each counts once, substrings count)."""
    low = F.lower(c)
    total = F.lit(0)
    for marker in markers:
        total = total + F.contains(low, F.lit(marker)).cast("int")
    return total


def _unbullet(c: Column) -> Column:
    return strip(F.btrim(strip(c), F.lit("-•*")))


def _unquote(c: Column) -> Column:
    return strip(F.btrim(F.btrim(strip(c), F.lit('"')), F.lit("'")))


def clean_title(c: Column) -> Column:
    """A title without list bullet, leading number and wrapping quotes."""
    return _unquote(F.regexp_replace(_unbullet(c), r"^\s*\d+\s*[:.)-]\s*", ""))


def clean_hook(c: Column) -> Column:
    """As ``clean_title``, and a leading ``Hook N:`` label goes too."""
    unlabelled = F.regexp_replace(_unbullet(c), r"(?i)^\s*hook\s*\d*\s*[:.)-]\s*", "")
    return _unquote(F.regexp_replace(unlabelled, r"^\s*\d+\s*[:.)-]\s*", ""))


def keywords(topic: Column, base: Column) -> Column:
    """Words of four letters and more, then the base words; the first of equals stays."""
    return F.array_distinct(F.concat(F.regexp_extract_all(F.lower(topic), F.lit("[A-Za-z]{4,}"), F.lit(0)), base))


def search_phrase(c: Column, stop_words: Iterable[str], limit: int = 4) -> Column:
    stop = F.array(*[F.lit(w) for w in stop_words])
    found = F.transform(
        F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[A-Za-z][A-Za-z'-]{3,}"), F.lit(0)), F.lower
    )
    kept = F.array_distinct(F.filter(found, lambda w: ~F.array_contains(stop, w)))
    return F.array_join(F.slice(kept, 1, limit), " ")


def fit(c: Column, limit: int | Column) -> Column:
    """``c`` cut to ``limit`` characters, the last one an ellipsis."""
    n = F.lit(limit) if isinstance(limit, int) else limit
    cut = F.regexp_replace(F.left(c, n - 1), r"\s+$", "")
    return F.when(F.length(c) <= n, c).otherwise(F.concat(cut, F.lit("…")))


def first_words(c: Column, limit: int) -> Column:
    """Up to ``limit`` words from the start; the rest of the text is not split."""
    return words(F.regexp_extract(c, rf"^\s*(?:\S+\s+){{0,{limit - 1}}}\S*", 0))


def overlay(c: Column, limit: int = 8) -> Column:
    w = first_words(c, limit + 1)
    return F.concat(
        F.array_join(F.slice(w, 1, limit), " "), F.when(F.size(w) > limit, F.lit("…")).otherwise(F.lit(""))
    )


def headline(c: Column, limit: int = 6) -> Column:
    return F.upper(F.array_join(first_words(c, limit), " "))


def visual_hint(c: Column, limit: int = 6) -> Column:
    """The first words longer than four letters, as a picture subject."""
    runs = F.regexp_extract_all(c, F.lit("[A-Za-z]{5,}"), F.lit(0))
    subject = F.array_join(F.slice(runs, 1, limit), ", ")
    return or_else(subject, F.lit("abstract concept"))


def sentences(c: Column) -> Column:
    """Sentences as spoken: section markers out, cut after ``. ! ?``, longer than three characters."""
    plain = strip(F.regexp_replace(c, r"\[[A-Z]+\]", " "))
    parts = F.transform(F.split(plain, r"(?<=[.!?])\s+"), strip)
    return F.filter(parts, lambda s: F.length(s) > 3)


def clauses(c: Column) -> Column:
    """Non-blank stretches between runs of ``. ! ?``."""
    return F.filter(F.split(c, r"[.!?]+"), lambda s: strip(s) != "")


def extract_sentences(c: Column, min_length: int = 30, limit: int = 6) -> Column:
    """The first sentences of an encyclopedia extract that are long enough to be a claim."""
    parts = F.transform(F.split(c, r"\. "), strip)
    return F.slice(F.filter(parts, lambda s: F.length(s) > min_length), 1, limit)


def sections(c: Column) -> Column:
    """Map header -> text of a ``[HEADER]text`` script; the last of equal headers wins.

    Without any header the whole text is the BODY.
    """
    headers = F.regexp_extract_all(c, F.lit(r"\[([A-Z]+)\]"), F.lit(1))
    bodies = F.transform(F.slice(F.split(c, r"\[[A-Z]+\]"), 2, 1_000_000_000), strip)
    # read from the end, so the first entry of a header is its last text
    none = F.array().cast("array<struct<header:string,body:string>>")
    kept = F.aggregate(
        F.reverse(F.zip_with(headers, bodies, lambda h, b: F.struct(h.alias("header"), b.alias("body")))), none,
        lambda acc, x: F.when(F.exists(acc, lambda y: y["header"] == x["header"]), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return F.when(F.size(headers) > 0, F.map_from_entries(kept)).otherwise(
        F.create_map(F.lit("BODY"), strip(c))
    )


def drop_phrases(c: Column, phrases: Iterable[str]) -> Column:
    out = c
    for phrase in phrases:
        out = F.regexp_replace(out, "(?i)\\Q" + phrase + "\\E", "")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def join_present(parts: Iterable[Column], separator: str = "\n\n") -> Column:
    cells = F.array(*[F.coalesce(p, F.lit("")) for p in parts])
    return F.array_join(F.filter(cells, lambda p: p != ""), separator)


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest (``don't`` -> ``Don'T``)."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.substr(r, F.lit(2)))), "")


def json_in_reply(c: Column) -> Column:
    """The JSON part of a model reply: the fenced block, else the text itself, else its ``{..}`` or ``[..]``."""
    text = strip(c)
    fence = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    inner = F.when(F.contains(text, F.lit("```")) & (fence != ""), strip(fence)).otherwise(text)
    block = F.regexp_extract(inner, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.when(F.try_parse_json(inner).isNotNull(), inner).otherwise(
        F.when(F.try_parse_json(block).isNotNull(), block)
    )


def summary(c: Column, limit: int = 500) -> Column:
    return F.concat(F.left(c, F.lit(limit)), F.when(F.length(c) > limit, F.lit("…")).otherwise(F.lit("")))


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """Literal ``{key}`` replacement, one column per key; unknown braces stay."""
    out = F.lit(template)
    for key, value in values.items():
        out = F.replace(out, F.lit("{" + key + "}"), F.coalesce(value.cast("string"), F.lit("None")))
    return out


def marked_prompt(task: str, values: dict[str, Column]) -> Column:
    """The prompt used when a task has no template: one ``KEY: value`` line per field."""
    lines = [F.lit(f"TASK: {task}")]
    lines += [F.concat(F.lit(f"{k.upper()}: "), F.coalesce(v.cast("string"), F.lit("None"))) for k, v in values.items()]
    return F.concat_ws("\n", *lines)
