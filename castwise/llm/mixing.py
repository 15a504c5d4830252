"""Mixing to target weights: domain posteriors from a labelled table, document rates by projected gradient."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from castwise.llm.common import free_name, query, read, some_of, Stage, utf8
from castwise.llm.quality import FEATURES, statistics

SAMPLE_ROWS = 12_000  # labelled documents the classifier is fitted on, at most
TELLING_WORDS = 512  # words whose presence is a feature, at most
WORD_BYTES = 64  # longer words are no features
LEAST_DOCS = 20  # sampled documents a telling word is in, at least
PUNCTUATION = bytes.maketrans(b".,;:!?()[]\"'*#$%&|", b" " * 18)
STEPS = 60
TOLERANCE = 1e-4  # largest difference of a domain's share from its target

SNAP = 0.05  # a rate this close to a whole number is that number

# Domains of the labelled table and their target shares of all tokens; the anchor keeps the tokens it has.
TARGETS = {"clean": 0.99, "low": 0.0, "toxic": 0.01}
ANCHOR = "clean"


def domain_of(quality: Column, toxic: Column) -> Column:
    """Domain of a labelled row; null where nothing is labelled."""
    return F.when(toxic == 1, "toxic").when(quality == 0, "low").when((quality == 1) & (toxic == 0), "clean")


@dataclass
class Classifier:
    """Softmax regression over document statistics and telling words."""

    domains: tuple[str, ...]
    words: dict[bytes, int]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # [feature + 1, domain]

    def features(self, data: bytes) -> np.ndarray:
        return describe(data, self.words)

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))]) @ self.weights
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def plain_words(data: bytes) -> set[bytes]:
    """The different words without punctuation, in lower case."""
    return set(data.lower().translate(PUNCTUATION).split())


def describe(data: bytes, words: Mapping[bytes, int]) -> np.ndarray:
    x = np.zeros(len(FEATURES) + len(words))
    x[: len(FEATURES)] = statistics(data)
    for w in words.keys() & plain_words(data):
        x[len(FEATURES) + words[w]] = 1
    return x


def softmax_regression(x: np.ndarray, y: np.ndarray, k: int, l2: float = 1e-4, steps: int = 300) -> np.ndarray:
    """Weights ``[feature, class]`` by accelerated gradient descent on mean log loss."""
    n, m = x.shape
    truth = np.zeros((n, k), np.float32)
    truth[np.arange(n), y] = 1
    vector = np.ones(m, np.float32) / np.float32(np.sqrt(m))
    for _ in range(20):  # the largest eigenvalue bounds the curvature
        vector = x.T @ (x @ vector)
        vector /= max(np.linalg.norm(vector), 1e-12)
    curvature = np.float32(0.5 * np.linalg.norm(x @ vector) ** 2 / n + l2)
    w = ahead = np.zeros((m, k), np.float32)
    for t in range(steps):
        z = x @ ahead
        e = np.exp(z - z.max(axis=1, keepdims=True))
        step = ahead - (x.T @ (e / e.sum(axis=1, keepdims=True) - truth) / n + np.float32(l2) * ahead) / curvature
        w, ahead = step, step + np.float32(t / (t + 3)) * (step - w)
    return w


def train(docs: DataFrame, labelled: DataFrame, domains: Sequence[str], stage: Stage, sample_rows: int = SAMPLE_ROWS) -> Classifier:
    """Classifier from ``labelled`` (``doc_id, domain``), fitted on at most ``sample_rows`` of its documents.

    The rows with the smallest hashed ids are taken. An id with several domains has the first by name,
    unknown domains count as unlabelled; of documents with the same id all are used. Without labelled documents every posterior is uniform.
    """
    domains = tuple(domains)
    named = labelled.filter(F.col("domain").isin(*domains) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    chosen = some_of(named, "doc_id", sample_rows)
    # bounded by sample_rows
    sample = stage(docs.select("doc_id", utf8(F.col("text")).alias("data")).join(F.broadcast(chosen), "doc_id"))

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, domain in zip(batch.column("data"), batch.column("domain")):
                words = [w for w in plain_words(data.as_py()) if len(w) <= WORD_BYTES]
                if words:
                    yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([domain.as_py()] * len(words))], ["word", "domain"])

    sizes = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    n = sum(sizes.values())
    if not n:
        width = len(FEATURES)
        return Classifier(domains, {}, np.zeros(width), np.ones(width), np.zeros((width + 1, len(domains))))
    seen = sample.select("data", "domain").mapInArrow(distinct_words, "word binary, domain string")
    per_word = seen.groupBy("word").agg(
        F.count("*").alias("n"), *[F.count(F.when(F.col("domain") == d, 1)).alias(f"n_{i}") for i, d in enumerate(domains)])
    # how far a domain's share among the documents with the word is from its share at large, in deviations
    far = [F.abs(F.col(f"n_{i}") - F.col("n") * (sizes.get(d, 0) / n)) / F.sqrt(F.col("n") * max(1e-6, (sizes.get(d, 0) / n) * (1 - sizes.get(d, 0) / n)))
           for i, d in enumerate(domains)]
    telling = per_word.filter(F.col("n") >= LEAST_DOCS).orderBy(F.desc(F.greatest(*far, F.lit(0.0))), "word").limit(TELLING_WORDS)
    words = {bytes(r["word"]): i for i, r in enumerate(telling.select("word").collect())}

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [describe(b.as_py(), words).astype(np.float32).tobytes() for b in batch.column("data")]
            yield pa.RecordBatch.from_arrays([batch.column("domain"), pa.array(x, pa.binary())], ["domain", "x"])

    rows = sample.mapInArrow(featured, "domain string, x binary")
    # several documents may share an id: a bounded number of rows is taken, smallest first
    rows = sorted((bytes(r["x"]), r["domain"]) for r in rows.orderBy("x", "domain").limit(sample_rows).collect())
    stage.drop(sample)
    x = np.array([np.frombuffer(a, np.float32) for a, _ in rows], np.float32)
    y = np.array([domains.index(d) for _, d in rows])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    scale[len(FEATURES):] = np.maximum(scale[len(FEATURES):], 0.05)
    ready = np.column_stack([(x - mean) / scale, np.ones(len(x), np.float32)]).astype(np.float32)
    return Classifier(domains, words, mean, scale, softmax_regression(ready, y, len(domains)))


@dataclass
class Rates:
    """Nonnegative rates as a function of the posteriors, told by the residuals of the projected steps from rate 1."""

    residuals: list[np.ndarray]

    def both(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rates after the last step and the point ahead of them that the next step starts from."""
        r = ahead = np.ones(len(p))
        for t, residual in enumerate(self.residuals):
            step = np.maximum(0.0, ahead - p @ residual)
            r, ahead = step, np.maximum(0.0, step + t / (t + 3) * (step - r))
        return r, ahead

    def of(self, p: np.ndarray) -> np.ndarray:
        return self.both(p)[0]


def fit_rates(members: DataFrame, domains: Sequence[str], targets: Mapping[str, float], anchor: str | None = None,
              steps: int = STEPS, tolerance: float = TOLERANCE) -> Rates:
    """Rates that bring the expected tokens per domain to their targets.

    The targets are shares of all tokens there are or, with an ``anchor``, of the total at which that domain
    keeps its expected tokens. ``members`` has ``n_tokens`` and ``p`` (posteriors). Minimises the squared distance of
    ``sum rate * n_tokens * p`` from the targets over rates >= 0 by accelerated gradient steps projected to the
    nonnegative. Measured per token, the gradient of a document is its posteriors times one residual per domain, and
    its curvature at most one, so every step has length one. A document's rate follows from the few residuals so
    far: nothing is kept per document, and a job per step adds up one row of totals per batch.
    """
    k = len(domains)
    asked = np.array([float(targets.get(d, 0.0)) for d in domains])
    if (asked < 0).any() or asked.sum() <= 0:
        raise ValueError("targets must be nonnegative and not all zero")
    asked = asked / asked.sum()

    def totals(rates: Rates) -> tuple[np.ndarray, float]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.column("n_tokens").to_numpy(zero_copy_only=False).astype(float)
                p = batch.column("p").flatten().to_numpy(zero_copy_only=False).reshape(len(n), k)
                sums = [*((n * rates.both(p)[1]) @ p), n.sum()]
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.float64()) for s in sums], [f"s{i}" for i in range(k + 1)])

        row = members.select("n_tokens", "p").mapInArrow(run, ", ".join(f"s{i} double" for i in range(k + 1))).agg(
            *[F.coalesce(F.sum(f"s{i}"), F.lit(0.0)) for i in range(k + 1)]).first()
        return np.array(row[:k]), row[k]

    rates = Rates([])
    mass, whole = totals(rates)
    if not whole:
        return rates
    if anchor is not None:
        i = list(domains).index(anchor)
        if asked[i] > 0 and mass[i] > 0:
            asked = asked * mass[i] / (whole * asked[i])
    for _ in range(steps):
        residual = mass / whole - asked
        if np.abs(residual).max() <= tolerance:
            break
        rates = Rates([*rates.residuals, residual])
        mass, _ = totals(rates)
    return rates


def posteriors(docs: DataFrame, model: Classifier, carry: Sequence[str], text: str = "text") -> DataFrame:
    """``carry`` columns, ``n_tokens`` (words) and ``p`` of every row."""

    @F.pandas_udf("n_tokens long, p array<double>")
    def member(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = np.array([model.features(b) for b in part]).reshape(len(part), len(model.mean))
            yield pd.DataFrame({"n_tokens": [len(b.split()) for b in part], "p": list(model.posteriors(x))})

    name = free_name(docs, "membership")
    return docs.withColumn(name, member(utf8(F.col(text)))).select(
        *carry, F.col(f"{name}.n_tokens").alias("n_tokens"), F.col(f"{name}.p").alias("p"))


def with_rates(members: DataFrame, rates: Rates, k: int) -> DataFrame:
    @F.pandas_udf("double")
    def rate(p: pd.Series) -> pd.Series:
        return pd.Series(rates.of(np.array(p.to_list(), float).reshape(len(p), k)))

    return members.withColumn("rate", rate(F.col("p")))


def copies(rate: Column, key: Column) -> Column:
    """Whole copies of a document: the rate rounded down or up, by a hash of the key in proportion to its fraction.

    Rates within ``SNAP`` of a whole number are not left to chance.
    """
    even = (F.pmod(F.xxhash64(key, F.lit("mix")), F.lit(1 << 30)) + 0.5) / (1 << 30)
    near = F.abs(rate - F.round(rate)) <= SNAP
    return F.when(near, F.round(rate)).otherwise(F.floor(rate + even)).cast("int")


def mixture(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float] = TARGETS, anchor: str | None = ANCHOR,
            key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, p_<domain>..., rate, copies`` of every row.

    Null texts count as empty and have no tokens, null keys and repeated rows are rated like any other.
    """
    stage = Stage(docs.sparkSession, "mixing")
    domains = sorted(targets)
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    model = train(source, labelled, domains, stage)
    members = stage(posteriors(source, model, ["doc_id"]))
    rated = with_rates(members, fit_rates(members, domains, targets, anchor), len(domains))
    return rated.select(
        F.col("doc_id").alias(key), "n_tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)],
        "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies"))


def mixed(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float] = TARGETS, anchor: str | None = ANCHOR,
            key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with each row repeated as often as its rate says (not at all for rate 0).

    The rate is a function of the text, so it is computed beside it again instead of joined to it.
    """
    stage = Stage(docs.sparkSession, "mixing-keep")
    domains = sorted(targets)
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    model = train(source, labelled, domains, stage)
    members = stage(posteriors(source, model, []))
    rates = fit_rates(members, domains, targets, anchor)

    @F.pandas_udf("double")
    def rate(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            x = np.array([model.features(b) for b in part]).reshape(len(part), len(model.mean))
            yield pd.Series(rates.of(model.posteriors(x)))

    own, copy = free_name(docs, "rate"), free_name(docs, "copy")
    times = copies(F.col(own), F.col(key))
    return docs.withColumn(own, rate(utf8(F.col(text)))).withColumn(
        copy, F.explode(F.array_repeat(F.lit(1), times))).drop(own, copy)


def labelled_domains(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("domain"))


@query("op5_mixing")
def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Rates that bring all documents to the target shares of clean, low and toxic tokens."""
    return mixture(read(spark, folder, "documents"), labelled_domains(read(spark, folder, "labels")))
