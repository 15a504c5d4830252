"""Closest match of every candidate in an existing corpus.

Three measures, one contract: for each candidate the highest similarity to any
existing item other than itself, exact wherever it reaches the threshold, and 0.0
below it. Equal items are collapsed first, so a text copied over a third of the
corpus is compared once. Texts are never compared with all others: their operators
derive from the threshold which pairs can reach it at all, and join only those. Vectors
are compared by blocks, as all that reach it have to be found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castwise.functions import text as X
from castwise.session import staged

BLOCKS = 24  # of vectors, as long as they fit
BLOCK_BYTES = 32 << 20  # of one block of vectors
TILE = 1024  # vectors compared at a time


# ---------------------------------------------------------------- character ratio

def char_ratio(a: str, b: str, autojunk: bool = False) -> float:
    """Matching-block ratio ``2M / (len(a) + len(b))`` of the standard library."""
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b, autojunk).ratio()


def _ratio_udf(threshold: float):
    # defined here so that it travels to the executors by value
    from difflib import SequenceMatcher

    def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            pair = SequenceMatcher(None, x, y, False)
            # the common characters, counted, bound the ratio from above
            out.append(pair.ratio() if pair.quick_ratio() >= threshold else 0.0)
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(ratios, T.DoubleType())


def _grams(c: Column, n: int) -> Column:
    """All ``n``-character pieces of a text, repeats included."""
    size = F.length(c)
    pieces = F.when(size >= n, F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.substr(c, i, F.lit(n))))
    return F.coalesce(pieces, F.array().cast("array<string>"))


def _by_merge(df: DataFrame) -> DataFrame:
    """No broadcast for an exploded side: Spark's estimate does not see how much rows multiply there."""
    return df.hint("merge")


def _first_meeting(pa: str, ia: str, pb: str, ib: str) -> Column:
    """Nothing before the current positions is common to both ordered lists."""
    # in near copies the entries just before agree almost always, which spares the full test
    just_before = F.coalesce(F.get(pa, F.col(ia) - 1) == F.get(pb, F.col(ib) - 1), F.lit(False))
    return ~just_before & ~F.arrays_overlap(F.slice(pa, F.lit(1), F.col(ia)), F.slice(pb, F.lit(1), F.col(ib)))


def closest_short_text(
    candidates: DataFrame,
    existing: DataFrame,
    key: str,
    candidate_text: str,
    existing_text: str,
    threshold: float = 0.8,
    existing_key: str | None = None,
) -> DataFrame:
    """(key, max_similarity, is_duplicate) by character ratio, for titles, topics and hooks.

    With ``existing_key`` a candidate is not compared with the existing row of its own key:
    only a copy under another key is a copy. Without it the tables have no rows in common.

    With M matched characters in k stretches, two texts have at least M - k character
    pairs in common, and k - 1 is at most the number of unmatched characters. A ratio
    at the threshold therefore implies a known minimum of common pairs, so texts are
    joined on their rarest pairs only (so many that one must agree), and the common
    characters are counted before the ratio itself is computed. Texts too short for
    that bound are joined on single characters in the same way.
    """
    t = threshold
    # texts below this length can reach the threshold without any common pair
    short = (2 - t) / (1.5 * t - 1) if t > 2 / 3 else math.inf
    cand = candidates.select(key, X.normalise(F.coalesce(F.col(candidate_text), F.lit(""))).alias("a"))
    own = F.col(existing_key) if existing_key else F.lit(None).cast("string")
    corpus = staged(
        existing.select(X.normalise(F.col(existing_text)).alias("text"), own.alias("own")).filter(F.col("text").isNotNull())
        .groupBy("text").agg(F.count("*").alias("copies"), F.min("own").alias("own")),
        "corpus-texts",
    )
    # a text that is there under another key needs no comparison
    only_self = (F.col("copies") == 1) & (F.col("own") == F.col(key))
    judged = staged(
        cand.join(corpus, F.col("a") == F.col("text"), "left")
        .select(key, "a", (F.col("copies").isNotNull() & ~F.coalesce(only_self, F.lit(False))).alias("copied")),
        "candidate-texts",
    )
    both = (
        judged.filter(~F.col("copied")).select(F.col("a").alias("text")).distinct().withColumn("is_candidate", F.lit(True))
        .unionByName(corpus.select("text", F.lit(False).alias("is_candidate")))
        .filter(F.col("text") != "")
        .withColumn("n", F.length("text"))
    )
    pieces = both.select("text", "is_candidate", "n", F.explode(F.concat(
        _grams(F.col("text"), 2),
        F.when(F.col("n") < short, _grams(F.col("text"), 1)).otherwise(F.array().cast("array<string>")),
    )).alias("piece"))
    # a repeated piece becomes several tokens, so that common tokens count repeats
    tokens = pieces.groupBy("text", "is_candidate", "n", "piece").agg(F.count("*").alias("times")).select(
        "text", "is_candidate", "n", (F.length("piece") == 1).alias("single"),
        F.explode(F.transform(F.sequence(F.lit(1).cast("long"), "times"), lambda k: F.concat("piece", F.lit("\x01"), k.cast("string"))))
        .alias("gram"),
    )
    df = tokens.groupBy("gram").agg(F.count("*").alias("df"))
    # one row per text: its tokens, rarest first, cut where a partner must have shown up; both lists are as short as the text
    in_order = lambda kind: F.array_sort(F.collect_list(F.when(kind, F.struct("df", "gram"))))
    lists = tokens.join(df, "gram").groupBy("text", "is_candidate", "n").agg(
        in_order(~F.col("single")).alias("pairs"), in_order(F.col("single")).alias("chars"))
    # for the shortest partner the length band allows, rounded towards keeping more
    pairs_needed = F.ceil(F.col("n") * ((3 * t - 2) / (2 - t)) - 1 - 1e-9)
    chars_needed = F.ceil(F.col("n") * (t / (2 - t)) - 1e-9)
    first = lambda c, k: F.slice(c, F.lit(1), F.greatest(k, F.lit(0)).cast("int"))
    index = lists.select("text", "is_candidate", "n", F.transform(F.array_sort(F.concat(
        first("pairs", F.col("n") - F.greatest(pairs_needed, F.lit(1))), first("chars", F.col("n") - chars_needed + 1),
    )), lambda r: r["gram"]).alias("prefix"))

    left = index.filter("is_candidate").select(
        F.col("text").alias("a"), F.col("n").alias("na"), F.col("prefix").alias("pa"), F.posexplode("prefix").alias("ia", "gram"))
    right = index.filter("not is_candidate").select(
        F.col("text").alias("b"), F.col("n").alias("nb"), F.col("prefix").alias("pb"), F.posexplode("prefix").alias("ib", "gram"))
    in_band = (F.col("nb") >= F.col("na") * (t / (2 - t)) - 1e-9) & (F.col("na") >= F.col("nb") * (t / (2 - t)) - 1e-9)
    # a pair meets at its first common token only and goes straight on to the maximum: pairs are not shuffled
    found = (
        left.join(_by_merge(right), "gram").filter((F.col("a") != F.col("b")) & in_band & _first_meeting("pa", "ia", "pb", "ib"))
        .withColumn("ratio", _ratio_udf(t)("a", "b"))
        .filter(F.col("ratio") >= t)
        .groupBy(F.col("a").alias("text")).agg(F.max("ratio").alias("ratio"))
    )
    joined = judged.join(found, judged["a"] == found["text"], "left")
    sim = F.when(F.col("copied"), 1.0).otherwise(F.coalesce("ratio", F.lit(0.0)))
    return joined.select(key, sim.alias("max_similarity"), (sim >= t).alias("is_duplicate"))


# ---------------------------------------------------------------- documents (see sets.py)

def originality(max_similarity: Column, script: Column) -> Column:
    """``(1 - similarity) * 100``; 0 for an empty script."""
    return F.when(X.present(script), F.round((F.lit(1.0) - max_similarity) * 100, 1)).otherwise(F.lit(0.0))


# ---------------------------------------------------------------- vectors

def cosine(a: Column, b: Column) -> Column:
    """Cosine of two equally long arrays; a zero vector gives 0."""
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return dot(a, b) / F.when(norm == 0, 1.0).otherwise(norm)


def lsh_shape(n: int, threshold: float, recall: float, bucket: int = 256) -> tuple[int, int]:
    """Hyperplanes per table and tables, so that unrelated vectors share buckets of about ``bucket`` and a pair
    at the threshold shares one with probability ``recall`` (closer pairs: more).

    Buckets keep their size as ``n`` grows; the tables grow as a small power of it (a third for 0.8).
    """
    agree = 1 - math.acos(threshold) / math.pi
    bits = min(30, max(1, math.ceil(math.log2(max(2, n / bucket)))))
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(agree**bits, 1 - 1e-12))))


def vector_buckets(units: DataFrame, width: int, bits: int, tables: int, seed: int = 20240131) -> DataFrame:
    """``(node, u, table, bucket)``: one row per unit vector and table; the bucket is the side of every hyperplane."""
    planes = np.random.default_rng(seed).normal(size=(tables * bits, width))
    weights = (1 << np.arange(bits)).astype(np.int64)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                side = (np.stack(pdf["u"].to_numpy()) @ planes.T > 0).reshape(len(pdf), tables, bits)
                yield pd.DataFrame({"node": pdf["node"], "u": pdf["u"], "buckets": list((side * weights).sum(axis=2))})

    placed = units.select("node", "u").mapInPandas(place, "node long, u array<double>, buckets array<long>")
    return placed.select("node", "u", F.posexplode("buckets").alias("table", "bucket"))


def block_count(n: int, width: int, block: int) -> int:
    """Blocks of ``block`` vectors; from ``BLOCKS`` on no more of them until they hold ``BLOCK_BYTES``."""
    return max(min(-(-n // block), BLOCKS), -(-n // max(block, BLOCK_BYTES // (8 * width))))


def block_pairs(placed: DataFrame, blocks: int) -> DataFrame:
    """``placed`` (node, u, bucket) dealt to ``blocks`` blocks, each row once for every pair of blocks its own is part of.

    Adds ``i <= j``, the pair, and ``own``, which of both the row belongs to. So a vector travels ``blocks`` times.
    """
    own = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")
    dealt = placed.select("node", "u", "bucket", own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("with"))
    return dealt.select("node", "u", "bucket", "own", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"))


def _tiles(rows: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes and unit vectors ordered by bucket; mean direction of every ``TILE`` of them and the largest angle to it."""
    rows = rows.sort_by([("bucket", "ascending"), ("node", "ascending")])
    u = pa.concat_arrays([c.flatten() for c in rows.column("u").chunks]).to_numpy().reshape(-1, width)
    cuts = [u[x: x + TILE] for x in range(0, len(u), TILE)]
    mean = np.stack([c.sum(axis=0) for c in cuts])
    length = np.linalg.norm(mean, axis=1)
    mean /= np.where(length == 0, 1, length)[:, None]
    wide = np.array([np.arccos(np.clip((c @ m).min(), -1, 1)) for c, m in zip(cuts, mean)])
    return rows.column("node").to_numpy(), u, mean, np.where(length == 0, np.pi, wide)


def _best_of_pair(table: pa.Table, width: int, threshold: float) -> pa.Table:
    """The highest cosine from ``threshold`` on of every vector of two blocks with any of the other block (of one: with any other).

    Tiles whose directions lie too far apart to hold a pair at the threshold are left out. Single precision tells
    which vectors of two tiles may have such a pair; their cosines are computed in double precision.
    """
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    left = table.filter(pc.equal(table.column("own"), i))
    right = left if i == j else table.filter(pc.equal(table.column("own"), j))
    if not len(left) or not len(right):
        return pa.table({"node": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
    nodes_a, a, mean_a, wide_a = _tiles(left, width)
    nodes_b, b, mean_b, wide_b = (nodes_a, a, mean_a, wide_a) if i == j else _tiles(right, width)
    a32 = a.astype(np.float32)
    b32 = a32 if i == j else b.astype(np.float32)
    best_a = np.full(len(a), -1.0)
    best_b = best_a if i == j else np.full(len(b), -1.0)
    reach = wide_a[:, None] + wide_b[None, :] + np.arccos(threshold) + 1e-6
    rough_threshold = threshold - 1e-5 - 2e-7 * width  # by more than single precision loses in a cosine
    near = np.arccos(np.clip(mean_a @ mean_b.T, -1, 1)) <= reach
    # of one block every two tiles meet once
    for x, y in np.argwhere(np.triu(near) if i == j else near).tolist():
        at, to = x * TILE, y * TILE
        rough = a32[at: at + TILE] @ b32[to: to + TILE].T
        if i == j and x == y:
            np.fill_diagonal(rough, -1)
        some = np.flatnonzero(rough.max(axis=1) >= rough_threshold)
        if len(some):
            sims = a[at + some] @ b[to: to + TILE].T
            if i == j and x == y:
                sims[np.arange(len(some)), some] = -1
            best_a[at + some] = np.maximum(best_a[at + some], sims.max(axis=1))
            best_b[to: to + TILE] = np.maximum(best_b[to: to + TILE], sims.max(axis=0))
    nodes, best = (nodes_a, best_a) if i == j else (np.concatenate([nodes_a, nodes_b]), np.concatenate([best_a, best_b]))
    return pa.table({"node": nodes[best >= threshold], "sim": best[best >= threshold]})


def closest_vector(
    vectors: DataFrame,
    threshold: float = 0.8,
    block: int = 2048,
    key: str = "vec_id",
) -> DataFrame:
    """(key, max_similarity, is_duplicate) by cosine, every vector against all others.

    Exact: different vectors are dealt to blocks of ``block`` of them, and every two blocks are compared in a task of
    their own, which reports one number per vector, never pairs. Of more than ``BLOCKS`` blocks they become larger
    instead, until they hold ``BLOCK_BYTES``: up to there what is shuffled grows as the table does, and a task
    holds two blocks whatever the table. The comparisons grow as its square. Inside a block vectors lie in the order of a
    table of random hyperplanes, so that tiles of clustered vectors are told apart by their mean directions.
    Vectors that are NULL, zero or not finite have similarity 0.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    vec = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))
    raw = vectors.select(F.col(key).alias("key"), vec.alias("v")).withColumn("v", F.when(F.coalesce(finite, F.lit(False)), F.col("v")))
    raw = raw.withColumn("v", F.when(norm > 0, F.col("v"))).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    rows = staged(raw, "vectors")
    same = ["h1", "h2"]  # equal vectors; joins and groups go by these, not by the arrays
    units = staged(
        rows.filter(F.col("v").isNotNull()).groupBy(*same).agg(F.count("*").alias("copies"), F.first("v").alias("v"))
        .select(*same, "copies", F.monotonically_increasing_id().alias("node"), F.transform("v", lambda x: x / norm).alias("u")),
        "unit-vectors",
    )
    n, width = units.agg(F.count("*"), F.max(F.size("u"))).first()
    if not n:
        return rows.select(F.col("key").alias(key), F.lit(0.0).alias("max_similarity"), F.lit(False).alias("is_duplicate"))
    bits, _ = lsh_shape(n, threshold, 0.99)
    placed = vector_buckets(units.filter(F.size("u") == width), width, bits, 1)
    found = (
        block_pairs(placed, block_count(n, width, block)).groupBy("i", "j").applyInArrow(lambda t: _best_of_pair(t, width, threshold), "node long, sim double")
        .groupBy("node").agg(F.max("sim").alias("sim"))
    )
    best = units.join(found, "node", "left").select(
        *same, F.when(F.col("copies") > 1, 1.0).otherwise(F.coalesce("sim", F.lit(0.0))).alias("sim"))
    sim = F.round(F.coalesce("sim", F.lit(0.0)), 6)
    return rows.join(best, same, "left").select(
        F.col("key").alias(key), sim.alias("max_similarity"), (F.coalesce("sim", F.lit(0.0)) >= threshold).alias("is_duplicate"))
