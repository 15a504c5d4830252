"""Whole-text work in one pass per text, on Arrow batches.

For what the JVM's regular expressions and array lambdas would read a text for many times over: every
function here takes the batch, goes through each text once with the worker's own string methods, and hands back one column.
Row-local; no shuffle. Blanks are the ASCII ones, as in the patterns of ``text``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from decimal import ROUND_HALF_UP, Decimal
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = " \t\n\x0b\x0c\r"
_NOT_LETTERS = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz" else 32 for c in range(256))
_NOT_WORDS = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz'" else 32 for c in range(256))
_STOPS = bytes.maketrans(b"!?", b"..")


def _column(fn: Callable, kind: str, arrow: pa.DataType, *columns: Column | str) -> Column:
    """``fn`` of every row's values; a null first value gives null."""

    def run(*arrays: pa.Array) -> pa.Array:
        return pa.array([None if row[0] is None else fn(*row) for row in zip(*(a.to_pylist() for a in arrays))], arrow)

    return F.arrow_udf(run, kind, F.ArrowUDFType.SCALAR)(*columns)


# ---------------------------------------------------------------- words

def normal_and_words(c: Column) -> Column:
    """Struct ``normal, words``: lower case with single blanks, and the number of words."""

    def one(text: str) -> dict:
        words = text.lower().encode().split()
        return {"normal": b" ".join(words).decode(), "words": len(words)}

    return _column(one, "normal string, words bigint", pa.struct([("normal", pa.string()), ("words", pa.int64())]), c)


def word_count(c: Column) -> Column:
    return _column(lambda text: len(text.encode().split()), "bigint", pa.int64(), c)


def keywords(c: Column, base: Column) -> Column:
    """``text.keywords``: words of four letters and more, then the base words; the first of equals stays."""

    def one(text: str, more: list[str]) -> list[str]:
        words = text.lower().encode("ascii", "replace").translate(_NOT_LETTERS).decode().split()
        return list(dict.fromkeys([w for w in words if len(w) > 3] + (more or [])))

    return _column(one, "array<string>", pa.list_(pa.string()), c, base)


def search_phrase(c: Column, stop_words: Iterable[str], limit: int = 4) -> Column:
    """The first ``limit`` different words of four letters and more that are no stop words; reading ends there."""
    stop = frozenset(stop_words)

    def one(text: str) -> str:
        found: dict[str, None] = {}
        for m in re.finditer("[A-Za-z][A-Za-z'-]{3,}", text):
            word = m.group().lower()
            if word not in stop:
                found[word] = None
                if len(found) == limit:
                    break
        return " ".join(found)

    return _column(one, "string", pa.string(), F.coalesce(c, F.lit("")))


def visual_hint(c: Column, limit: int = 6, otherwise: str = "abstract concept") -> Column:
    """The first words longer than four letters, as a picture subject; reading ends there."""
    one = lambda text: ", ".join(m.group() for m in islice(re.finditer("[A-Za-z]{5,}", text), limit)) or otherwise
    return _column(one, "string", pa.string(), F.coalesce(c, F.lit("")))


def extract_sentences(c: Column, min_length: int = 30, limit: int = 6) -> Column:
    """``text.extract_sentences``: the first sentences that are long enough to be a claim; reading ends there."""

    def one(text: str) -> list[str]:
        out, start = [], 0
        while start <= len(text) and len(out) < limit:
            end = text.find(". ", start)
            sentence = text[start: end if end >= 0 else len(text)].strip(BLANK)
            if len(sentence) > min_length:
                out.append(sentence)
            start = end + 2 if end >= 0 else len(text) + 1
        return out

    return _column(one, "array<string>", pa.list_(pa.string()), c)


def title_case(c: Column) -> Column:
    """``text.title_case``: the first letter of every run of letters upper-case, the rest lower-case."""

    def one(text: str) -> str:
        low = text.lower()
        # ``title`` does just this where every letter has a case and one capital
        if low.isascii() or (max(low) < "\u0100" and not any(x in low for x in "ßªº")):
            return low.title()
        return regex.sub(r"\p{L}+", lambda m: m.group()[0].upper() + m.group()[1:], low)

    return _column(one, "string", pa.string(), c)


# ---------------------------------------------------------------- markers and phrases

def story_counts(c: Column, beats: Iterable[Iterable[str]], emotion_words: Iterable[str]) -> Column:
    """Struct of what ``scores.storytelling`` needs: beats found, tokens, emotive ones, clauses, their words and squared words."""
    groups, lexicon = [tuple(g) for g in beats], frozenset(w.encode() for w in emotion_words)
    names = ("beats", "tokens", "hits", "clauses", "words", "squares")

    def one(text: str) -> tuple:
        low = text.lower()
        tokens = low.encode("ascii", "replace").translate(_NOT_WORDS).split()
        sizes = [n for n in (len(s.split()) for s in text.encode().translate(_STOPS).split(b".")) if n]
        return (sum(any(w in low for w in g) for g in groups), len(tokens), sum(map(lexicon.__contains__, tokens)),
                len(sizes), sum(sizes), sum(n * n for n in sizes))

    def run(texts: pa.Array) -> pa.Array:
        rows = [(None,) * 6 if t is None else one(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], names)

    return F.arrow_udf(run, ", ".join(f"{n} bigint" for n in names), F.ArrowUDFType.SCALAR)(c)


def without_phrases(text: str, phrases: Sequence[tuple[bytes, re.Pattern]]) -> str:
    """The text without the phrases, one after the other; a pattern runs only where its phrase occurs."""
    data = text.encode()
    for phrase, pattern in phrases:
        if phrase in data.lower():
            data = pattern.sub(b"", data)
    if b"\n\n\n" in data:
        data = re.sub(rb"\n{3,}", b"\n\n", data)
    return data.decode().strip(BLANK)


def drop_phrases(c: Column, phrases: Iterable[str]) -> Column:
    """``text.drop_phrases``: ASCII letters match in either case."""
    told = [(p.encode().lower(), re.compile(re.escape(p.encode()), re.IGNORECASE)) for p in phrases]
    return _column(lambda text: without_phrases(text, told), "string", pa.string(), c)


def sections(c: Column) -> Column:
    """``text.sections``: header -> text of a ``[HEADER]text`` script, the last of equal headers; without any the whole is the BODY."""

    def one(text: str) -> list[tuple[str, str]]:
        parts = re.split(r"\[([A-Z]+)\]", text)
        if len(parts) == 1:
            return [("BODY", text.strip(BLANK))]
        return list({h: b.strip(BLANK) for h, b in zip(parts[1::2], parts[2::2])}.items())

    found = _column(one, "map<string,string>", pa.map_(pa.string(), pa.string()), c)
    return F.coalesce(found, F.create_map(F.lit("BODY"), F.lit(None).cast("string")))


# ---------------------------------------------------------------- scenes

SCENES = "array<struct<idx:int,narration:string,duration:double>>"
CUES = "array<struct<cue:bigint,begin:bigint,stop:bigint,caption:string>>"


def half_up(x: np.ndarray, digits: int = 2) -> np.ndarray:
    """Whole units of the last digit, rounded half up on the printed digits as Spark's ``round`` does."""
    y = x * 10**digits
    out = np.floor(y + 0.5).astype(np.int64)
    step = Decimal(1).scaleb(-digits)
    for i in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-6 * np.maximum(1, np.abs(y))):
        out[i] = int(Decimal(repr(float(x[i]))).quantize(step, ROUND_HALF_UP).scaleb(digits))
    return out


def sentences(text: str) -> list[str]:
    """``text.sentences``: section markers out, cut after ``. ! ?``, longer than three characters."""
    if "[" in text:
        text = re.sub(r"\[[A-Z]+\]", " ", text)
    text, start, out = text.strip(BLANK), 0, []
    for m in re.finditer(r"[.!?][ \t\n\x0b\x0c\r]+", text):
        out.append(text[start: m.start() + 1])
        start = m.end()
    out.append(text[start:])
    return [s for s in (s.strip(BLANK) for s in out) if len(s) > 3]


def _lists(sizes: Sequence[int], *fields: pa.Array, names: Sequence[str], missing: np.ndarray | None = None) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    values = pa.StructArray.from_arrays(list(fields), list(names))
    mask = None if missing is None or not missing.any() else pa.array(missing)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=mask)


def scenes(script: Column, words_per_minute: int, least: float, most: float) -> Column:
    """The timed sentences of a script: reading time by words, within bounds."""

    def run(scripts: pa.Array) -> pa.Array:
        told = [None if t is None else sentences(t) for t in scripts.to_pylist()]
        flat = [s for t in told if t for s in t]
        words = np.maximum(1, np.array([len(s.encode().split()) for s in flat], np.int64))
        spoken = (12_000 * words + words_per_minute) // (2 * words_per_minute) / 100
        sizes = [len(t) if t else 0 for t in told]
        idx = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes] or [np.zeros(0, np.int32)])
        return _lists(sizes, pa.array(idx), pa.array(flat, pa.string()), pa.array(np.clip(spoken, least, most)),
                      names=("idx", "narration", "duration"), missing=np.array([t is None for t in told], bool))

    return F.arrow_udf(run, SCENES, F.ArrowUDFType.SCALAR)(script)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Sizes, which are null, and the entries of a list column."""
    sizes = np.array(lists.value_lengths().fill_null(0))
    return sizes, np.array(lists.is_null()), lists.flatten()


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], values.cumsum()])[np.concatenate([[0], sizes.cumsum()])])


def rescaled(scenes_: Column, spoken: Column, floor: float, tolerance: float) -> Column:
    """Scenes stretched to ``spoken`` seconds where their sum is farther from it than ``tolerance``."""

    def run(lists: pa.Array, wanted: pa.Array) -> pa.Array:
        sizes, missing, entries = _flat(lists)
        duration = entries.field("duration").to_numpy(zero_copy_only=False)
        shown = np.maximum(duration, floor)
        total = _sums(half_up(shown), sizes) / 100
        seconds = np.nan_to_num(wanted.to_numpy(zero_copy_only=False).astype(float))
        off = (seconds > 0) & (total > 0) & (np.abs(total - seconds) > tolerance)
        factor = np.repeat(np.divide(seconds, total, out=np.ones(len(total)), where=off), sizes)
        stretched = np.where(np.repeat(off, sizes), half_up(shown * factor) / 100, duration)
        return _lists(sizes, entries.field("idx"), entries.field("narration"), pa.array(stretched), names=("idx", "narration", "duration"), missing=missing)

    return F.arrow_udf(run, SCENES, F.ArrowUDFType.SCALAR)(scenes_, spoken.cast("double"))


def cues(scenes_: Column, floor: float) -> Column:
    """Numbered cues with begin and stop in hundredths of seconds; blank scenes take time but have no cue."""

    def run(lists: pa.Array) -> pa.Array:
        sizes, missing, entries = _flat(lists)
        said = [(s or "").strip(BLANK) for s in entries.field("narration").to_pylist()]
        shown = np.array([s != "" for s in said], bool)
        took = half_up(np.maximum(entries.field("duration").to_numpy(zero_copy_only=False), floor))
        first = np.repeat(sizes.cumsum() - sizes, sizes)

        def running(values: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], values.cumsum()])
            return sums[1:] - sums[first]

        stop, number = running(took), running(shown.astype(np.int64))
        kept = _sums(shown.astype(np.int64), sizes)
        return _lists(kept, pa.array(number[shown]), pa.array((stop - took)[shown]), pa.array(stop[shown]),
                      pa.array([s for s in said if s], pa.string()), names=("cue", "begin", "stop", "caption"), missing=missing)

    return F.arrow_udf(run, CUES, F.ArrowUDFType.SCALAR)(scenes_)


def total_seconds(scenes_: Column) -> Column:
    """Sum of the durations of a row's scenes."""

    def run(lists: pa.Array) -> pa.Array:
        sizes, missing, entries = _flat(lists)
        total = _sums(half_up(entries.field("duration").to_numpy(zero_copy_only=False)), sizes) / 100
        return pa.array(total, mask=missing)

    return F.arrow_udf(run, "double", F.ArrowUDFType.SCALAR)(scenes_)
