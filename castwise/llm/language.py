"""Language identification: TF-IDF character n-grams, nearest of several centroids per language by cosine, rejection by distance.

1. Document frequencies of hashed n-grams are counted per language over all documents that may be learned from.
2. A bounded sample per language becomes normalised TF-IDF vectors, which spherical k-means clusters in one task per language.
3. Every whole text is compared with all centroids; one farther from its centroid than that centroid's
   radius allows is marked as rejected. No shuffle and no join of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from castwise.llm.common import Stage, fold, free_name, query, read

SAMPLE_ROWS = 1_200  # documents per language that the centroids are clustered from, at most
CENTROIDS = 4  # per language
WIDTH = 8_192  # hashed n-grams
ORDERS = (1, 2, 3)  # letters of an n-gram
PASSES = 12
HELD_OUT, FOLDS = 2, 4  # rows of this fold are never learned from
UNKNOWN = "und"
QUANTILE, ROOM = 0.99, 1.5  # radius of a centroid: this quantile of its members' distances, times the room
BLOCK = 1 << 20  # letters of a text handled at once
SLICE = 256  # texts turned into vectors at once
OPEN_LANGUAGES = 64  # languages whose counts one task holds


@cache
def _letters() -> np.ndarray:
    """For every code point: 2 for letters, 1 for marks that belong to a word, 0 otherwise."""
    import unicodedata

    kinds = {"L": 2, "M": 1}
    return np.array([kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)


def counts(text: str) -> np.ndarray | None:
    """How often each hashed n-gram of the text's words occurs; none if it has no letter.

    Words are runs of letters in lower case, with a blank before and behind; all of the text is read, block by block.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    total, seen = np.zeros(WIDTH, np.int64), False
    back = max(ORDERS) - 1
    last = np.zeros(1, np.uint32)
    for start in range(0, len(codes), BLOCK):
        part = codes[start: start + BLOCK]
        kind = _letters()[part]
        seen = seen or bool((kind == 2).any())
        part = np.where(kind > 0, part, 0)
        old = len(last)
        part = np.concatenate([last, part, [0]] if start + BLOCK >= len(codes) else [last, part]).astype(np.uint64)
        blank = part == 0
        keep = np.ones(len(part), bool)
        keep[1:] = ~(blank[1:] & blank[:-1])  # runs of blanks are one
        old = int(keep[:old].sum())
        part = part[keep]
        for n in ORDERS:
            if len(part) < n:
                continue
            h = part[: len(part) - n + 1].copy()
            for k in range(1, n):
                h = h * np.uint64(1_000_003) + part[k: len(part) - n + 1 + k]
            # n-grams that end in what was carried over are counted already
            h = h[max(0, old - n + 1):] if start else h
            if n == 1:
                h = h[h > 0]
            h = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            total += np.bincount((h >> np.uint64(51)).astype(np.int64), minlength=WIDTH)
        last = part[-back:].astype(np.uint32)
    return total if seen else None


def _texts(column: pa.Array) -> list[str]:
    return [(b.as_py() or b"").decode("utf-8", "replace") for b in column]


def vectors(texts: list[str], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised TF-IDF rows, and which texts have a letter (the others' rows are zero)."""
    out, known = np.zeros((len(texts), WIDTH), np.float32), np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        c = counts(text)
        if c is not None:
            row = np.log1p(c) * weight
            norm = np.linalg.norm(row)
            known[i] = True
            out[i] = row / norm if norm > 0 else 0
    return out, known


@dataclass
class Model:
    """Unit centroids ``[k, WIDTH]`` in order of their languages, the radius of each, and the n-grams' weights."""

    weight: np.ndarray
    langs: list[str]
    centroids: np.ndarray
    radius: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and rejection of every text; ties go to the language that sorts first."""
        langs, score, far = [], np.zeros(len(texts)), np.ones(len(texts), bool)
        for s in range(0, len(texts), SLICE):
            x, known = vectors(texts[s: s + SLICE], self.weight)
            if not self.langs:
                langs += [UNKNOWN] * len(x)
                continue
            cosine = np.clip(x.astype(np.float64) @ self.centroids.T, 0, 1)
            best = cosine.argmax(axis=1)
            top = cosine[np.arange(len(x)), best]
            score[s: s + len(x)] = np.where(known, top, 0)
            far[s: s + len(x)] = ~known | (1 - top > self.radius[best])
            langs += [self.langs[b] if k else UNKNOWN for b, k in zip(best, known)]
        return langs, score, far


def cluster(x: np.ndarray, k: int = CENTROIDS, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means of unit rows from far-apart starts: unit centroids and the radius of each.

    Fewer centroids come back if there are fewer different rows.
    """
    first = x.sum(axis=0)
    centroids = (first / max(np.linalg.norm(first), 1e-12))[None, :]
    while len(centroids) < min(k, len(x)):
        near = (x @ centroids.T).max(axis=1)
        if near.min() > 1 - 1e-6:
            break
        # a row from the far tenth, not the farthest: that one may be like no other
        centroids = np.vstack([centroids, x[np.argsort(near, kind="stable")[len(x) // 10]]])
    part = None
    for _ in range(passes):
        now = (x @ centroids.T).argmax(axis=1)
        if part is not None and (now == part).all():
            break
        part = now
        sums = np.stack([x[part == c].sum(axis=0) for c in range(len(centroids))])
        norms = np.linalg.norm(sums, axis=1)
        centroids = np.where(norms[:, None] > 0, sums / np.maximum(norms, 1e-12)[:, None], centroids)
    near = x @ centroids.T
    sizes = np.bincount(near.argmax(axis=1), minlength=len(centroids))
    used = np.flatnonzero(sizes * 50 >= len(x))  # less than a fiftieth of the rows is no cluster
    near, part = near[:, used], near[:, used].argmax(axis=1)
    centroids, used = centroids[used], np.arange(len(used))
    far = [np.quantile(1 - near[part == c, c], QUANTILE) for c in used]
    return centroids, np.minimum(1.0, np.array(far) * ROOM)


def frequencies(learn: DataFrame) -> DataFrame:
    """``lang, gram, n``: documents of each language with the n-gram; gram -1 counts all with a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang, n in held.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at)), pa.array((at - 1).astype(np.int32)), pa.array(n[at])], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for s in range(0, batch.num_rows, SLICE):
                for lang, text in zip(langs[s: s + SLICE], _texts(batch.column("data")[s: s + SLICE])):
                    c = counts(text)
                    if c is None:
                        continue
                    if lang not in held and len(held) >= OPEN_LANGUAGES:
                        yield from told()
                    n = held.setdefault(lang, np.zeros(WIDTH + 1, np.int64))
                    n[0] += 1
                    n[1:] += c > 0
        yield from told()

    return learn.mapInArrow(run, "lang string, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _learnable(docs: DataFrame) -> DataFrame:
    rows = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    return rows.select("doc_id", "lang", F.col("text").cast("binary").alias("data"))


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, centroids: int = CENTROIDS) -> Model:
    """The model of the documents with text and language outside the held-out fold; empty without any.

    Weights rest on all these documents, each language counting alike. The sample is cut by a hash of id and
    text, so the choice repeats, and equal rows are one. The driver receives centroids and weights:
    about ``centroids * WIDTH`` numbers a language, whatever the number of documents.
    """
    stage = Stage(docs.sparkSession, "language")
    learn = _learnable(docs)
    seen = stage(frequencies(learn))
    sizes = seen.filter("gram = -1").select("lang", F.col("n").alias("docs"))
    shares = seen.filter("gram >= 0").join(F.broadcast(sizes), "lang").groupBy("gram").agg(
        F.sum(F.round(F.col("n") / F.col("docs") * 1_000_000).cast("bigint")).alias("share"))
    languages = sizes.count()
    weight = np.zeros(WIDTH)
    for gram, share in shares.collect():  # at most WIDTH rows
        weight[gram] = max(0.0, 1.0 + np.log(languages / (share / 1_000_000 + 1e-6)))
    h = F.xxhash64("doc_id", "data")
    dealt = F.pmod(h, F.lit(1 << 30)) / F.lit(float(1 << 30))
    # the cut by hash is made where the text is read; only little more than the sample is shuffled
    near = learn.join(F.broadcast(sizes), "lang").filter(dealt <= 1.5 * sample_rows / F.col("docs")).withColumn("h", h)
    first = Window.partitionBy("lang").orderBy("h")
    sample = near.dropDuplicates(["lang", "h"]).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= sample_rows)

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("h")
        x, known = vectors(_texts(table.column("data").combine_chunks()), weight)
        kinds = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("radius", pa.float64()), ("centroid", pa.binary())])
        if not known.any():
            return kinds.empty_table()
        found, radius = cluster(x[known], centroids)
        return pa.table([pa.array([table.column("lang")[0].as_py()] * len(found)), pa.array(range(len(found)), pa.int32()),
                         pa.array(radius.astype(float)), pa.array([c.astype(np.float32).tobytes() for c in found])], kinds)

    rows = sample.groupBy("lang").applyInArrow(fit, "lang string, n int, radius double, centroid binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["n"]))
    matrix = np.array([np.frombuffer(r["centroid"], np.float32) for r in rows]).reshape(len(rows), WIDTH)
    return Model(weight, [r["lang"] for r in rows], matrix, np.array([r["radius"] for r in rows]))


def identified(docs: DataFrame, model: Model, text: str = "text", name: str = "language") -> DataFrame:
    """``docs`` with a struct column ``lang, score, rejected`` from the whole text.

    ``lang`` is the nearest language, ``und`` for texts that are null or have no letter (score 0, rejected) and for every text if
    nothing was learned. ``rejected`` texts are farther from their centroid than its radius: likely no language the model knows.
    """

    @F.pandas_udf("lang string, score double, rejected boolean")
    def tell(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            langs, score, far = model.predict([(b or b"").decode("utf-8", "replace") for b in part])
            yield pd.DataFrame({"lang": langs, "score": score, "rejected": far})

    return docs.withColumn(name, tell(F.col(text).cast("binary")))


def kept(docs: DataFrame, model: Model, langs: list[str], reject: bool = True) -> DataFrame:
    """The documents in one of the languages, unchanged; with ``reject`` those too far from their language go too."""
    name = free_name(docs, "language")
    told = identified(docs, model, name=name)
    fits = F.col(f"{name}.lang").isin(*langs)
    return told.filter(fits & ~F.col(f"{name}.rejected") if reject else fits).drop(name)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id, FOLDS) == HELD_OUT, F.lit(False))


@query("op11_language")
def op11_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document by its whole text; null ids are in no fold and never learned from."""
    docs = read(spark, folder, "documents").select("doc_id", "text", "lang")
    model = train(docs)
    return identified(docs.drop("lang"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score", "language.rejected")
