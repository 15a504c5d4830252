"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened for numpy."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castwise.llm.common import fold, free_name, query, read, some_of, utf8

SAMPLE_ROWS = 20_000  # labelled documents that the trees are fitted on, at most
HELD_OUT, FOLDS = 2, 4  # rows of this fold never serve as labels
ACCEPT = 0.7

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = b"0123456789"
SYMBOLS = b"#$%&*@^~_=+<>{}[]\\/"
PIPES, SHOUTS, STOPS, COMMAS, SPACES = b"|", b"!?", b".", b",;:", b" \t\n\r\x0b\x0c"
ABOVE_ASCII = bytes(range(128, 256))
CLASSES = (UPPER, LOWER, DIGITS, SYMBOLS, PIPES, SHOUTS, STOPS, COMMAS, SPACES, ABOVE_ASCII)
FEATURES = (
    "bytes words lines upper lower digits symbols pipes shouts stops commas spaces above_ascii word_length longest_word "
    "distinct top_word repeated distinct_lines longest_line line_upper line_symbols line_repeated line_distinct clean_lines links"
).split()


def _share(data: bytes, chars: bytes) -> float:
    return (len(data) - len(data.translate(None, chars))) / len(data) if data else 0.0


def statistics(data: bytes) -> list[float]:
    """The document statistics named in ``FEATURES``, of the whole text."""
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    n = len(words)
    counts = Counter(words)
    out = [math.log1p(len(data)), math.log1p(n), math.log1p(len(lines)), *(_share(data, c) for c in CLASSES)]
    out += [sum(map(len, words)) / n, math.log1p(max(map(len, words)))] if n else [0.0, 0.0]
    out += [len(counts) / n, max(counts.values()) / n, sum(map(eq, words, words[1:])) / n] if n else [0.0, 0.0, 0.0]
    out += [len(set(lines)) / len(lines), math.log1p(max(map(len, lines)))] if lines else [0.0, 0.0]
    worst_upper = worst_symbols = worst_repeat = 0.0
    least_distinct, clean = 1.0, 0
    for line in lines:
        if len(line) < 40:
            continue
        upper, symbols = _share(line, UPPER), _share(line, SYMBOLS + PIPES)
        parts = line.split()
        repeat = sum(map(eq, parts, parts[1:])) / len(parts)
        distinct = len(set(parts)) / len(parts)
        worst_upper, worst_symbols, worst_repeat = max(worst_upper, upper), max(worst_symbols, symbols), max(worst_repeat, repeat)
        least_distinct = min(least_distinct, distinct)
        if upper < 0.2 and symbols < 0.02 and repeat < 0.1:
            clean += len(line)
    out += [worst_upper, worst_symbols, worst_repeat, least_distinct, clean / len(data) if data else 0.0]
    out.append((data.count(b"http") + data.count(b"www.")) / (n or 1))
    return out


@dataclass
class Trees:
    """Complete binary trees of one depth: inner nodes and leaves in arrays, root first, children of i at 2i+1 and 2i+2."""

    base: float
    feature: np.ndarray  # [tree, inner node]
    threshold: np.ndarray  # a row goes right if its value is larger
    leaf: np.ndarray  # [tree, leaf]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for every row of statistics."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15,
        l2: float = 1.0, least: float = 1.0) -> Trees:
    """Boosted trees of log loss. Splits are searched over per-node histograms of binned gradients."""
    inner = (1 << depth) - 1
    if not len(y) or y.min() == y.max():
        share = 1.0 if not len(y) else float(y.mean())
        odds = math.log((share + 1e-4) / (1 - share + 1e-4))
        return Trees(odds, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.column_stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(k)])
    flat = binned + np.arange(k) * bins
    base = math.log(y.mean() / (1 - y.mean()))
    total = np.full(n, base)
    feature, threshold, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        f, t = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 1 << level, (1 << level) - 1
            at = ((node - first) * (k * bins))[:, None] + flat
            size = width * k * bins
            gs = np.bincount(at.ravel(), np.repeat(g, k), size).reshape(width, k, bins).cumsum(axis=2)
            hs = np.bincount(at.ravel(), np.repeat(h, k), size).reshape(width, k, bins).cumsum(axis=2)
            ga, ha = gs[:, :1, -1:], hs[:, :1, -1:]
            gain = gs**2 / (hs + l2) + (ga - gs) ** 2 / (ha - hs + l2) - ga**2 / (ha + l2)
            gain[(hs < least) | (ha - hs < least)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for i in range(width):
                j, b = divmod(int(best[i]), bins)
                if gain[i, j, b] > 1e-9 and b < len(edges[j]):
                    f[first + i], t[first + i] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), f[node]] > t[node])
        at = node - inner
        leaf = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + l2)
        total += leaf[at]
        feature.append(f)
        threshold.append(t)
        leaves.append(leaf)
    return Trees(base, np.array(feature), np.array(threshold), np.array(leaves))


def labelled(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, y, x``: statistics of at most ``sample_rows`` labelled documents outside the held-out fold.

    The rows with the smallest hashed ids are taken, so the choice repeats. Null and conflicting labels
    count as none and as the lower one; of documents with the same id one is used.
    """
    usable = labels.filter(F.col("quality").isin(0, 1) & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    chosen = some_of(usable.groupBy("doc_id").agg(F.min("quality").alias("y")), "doc_id", sample_rows)
    # bounded by sample_rows: two numbers a row
    texts = docs.select("doc_id", utf8(F.col("text")).alias("data")).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([statistics(b.as_py()) for b in batch.column("data")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), x], ["doc_id", "y", "x"])

    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y {labels.schema['quality'].dataType.simpleString()}"
    counted = texts.mapInArrow(run, f"{kinds}, x array<double>")
    return counted.groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("row")).select("doc_id", "row.y", "row.x")


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, **options) -> Trees:
    """Trees fitted on the bounded sample. Without labels every document scores 1, with one class that class."""
    rows = sorted(labelled(docs, labels, sample_rows).collect(), key=lambda r: r["doc_id"])
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r["y"] for r in rows], float), **options)


def scored(docs: DataFrame, model: Trees, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text (null counts as empty). No shuffle, no join."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(model.score(np.array([statistics(b) for b in part], float).reshape(len(part), len(FEATURES))))

    return docs.withColumn(name, score(utf8(F.col(text))))


def accepted(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The documents that score at least ``accept``, unchanged."""
    name = free_name(docs, "score")
    return scored(docs, train(docs, labels), name=name).filter(F.col(name) >= accept).drop(name)


@query("op7_quality")
def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document; null ids are in no fold."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    model = train(docs, read(spark, folder, "labels"))
    return scored(docs, model).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
