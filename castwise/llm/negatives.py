"""Hard negatives by inner product: STR-packed R-trees over shards, interval bounds, best-first search of score windows.

1. Rows are range-partitioned by label and widest coordinate into shards of bounded size (the first cut of
   sort-tile-recursive packing); the others are made inside a shard, down to leaves of a few rows.
2. A box ``[lo, hi]`` bounds an anchor's inner products coordinate by coordinate: each adds between
   ``min(q*lo, q*hi)`` and ``max(q*lo, q*hi)``. The boxes of whole shards decide which shards an anchor goes to.
3. Inside a shard a queue opens the box of highest bound first and drops boxes that lie outside every score
   window, or strictly below the k-th best found. Shards give their first few, which are merged per anchor.

Positives are searched in the most promising shard first; its k-th best closes most of the others. All results are exact.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from castwise.llm.common import Stage, query, read

SHARD = 8_192  # rows of a shard
LEAF, FAN = 32, 16  # rows of a leaf, children of an inner box
TILED = 3  # coordinates that tile a shard, the widest ones
ASKED = 1_024  # anchors searched together in one copy of a shard
BOXES = 256  # shard boxes told to an anchor in one row
LARGEST = 1 << 24  # components of this size and more have no exact products here
EXACT = 1 << 53  # whole numbers below are exact as doubles
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # a negative's score in hundredths of the positive's


def tiles(keys: list[np.ndarray], leaf: int = LEAF) -> list[np.ndarray]:
    """Sort-tile-recursive packing: row numbers of every leaf, in tree order.

    Rows are sorted by the first key and cut into slabs, each slab by the next key, and so on.
    """

    def cut(rows: np.ndarray, at: int) -> list[np.ndarray]:
        rows = rows[np.argsort(keys[at][rows], kind="stable")]
        left = len(keys) - at
        leaves = math.ceil(len(rows) / leaf)
        slabs = leaves if left == 1 else math.ceil(leaves ** (1 / left))
        size = math.ceil(leaves / slabs) * leaf
        parts = [rows[s: s + size] for s in range(0, len(rows), size)]
        return parts if left == 1 else [t for p in parts for t in cut(p, at + 1)]

    return cut(np.arange(len(keys[0])), 0) if len(keys[0]) else []


@dataclass
class Tree:
    """An R-tree in arrays: box i covers children ``first[i] .. first[i] + count[i]``, rows for leaves, boxes otherwise."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray  # rows in leaf order
    leaves: int  # boxes below this number are leaves; the root is the last
    first: np.ndarray
    count: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    label_lo: np.ndarray
    label_hi: np.ndarray


def build(ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> Tree:
    """The tree of the rows: packed by label and the widest coordinates, then ``FAN`` boxes to one above."""
    widest = np.argsort(-x.astype(np.float64).var(axis=0), kind="stable")[:TILED]
    packed = tiles([labels, *(x[:, j] for j in widest)])
    order = np.concatenate(packed)
    ids, labels, x = ids[order], labels[order], x[order]
    count = [np.array([len(p) for p in packed])]
    first = [np.concatenate([[0], count[0].cumsum()[:-1]])]
    lo, hi = [np.minimum.reduceat(x, first[0])], [np.maximum.reduceat(x, first[0])]
    label_lo, label_hi = [np.minimum.reduceat(labels, first[0])], [np.maximum.reduceat(labels, first[0])]
    base = 0
    while len(lo[-1]) > 1:
        starts = np.arange(0, len(lo[-1]), FAN)
        first.append(base + starts)
        count.append(np.minimum(FAN, len(lo[-1]) - starts))
        base += len(lo[-1])
        lo.append(np.minimum.reduceat(lo[-1], starts))
        hi.append(np.maximum.reduceat(hi[-1], starts))
        label_lo.append(np.minimum.reduceat(label_lo[-1], starts))
        label_hi.append(np.maximum.reduceat(label_hi[-1], starts))
    return Tree(ids, labels, x, len(packed), *(np.concatenate(a) for a in (first, count, lo, hi, label_lo, label_hi)))


def bounds(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product ``[query, box]`` that a row in each box can have."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    return up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T


def search(tree: Tree, q: np.ndarray, own: int, label: int, same: bool, windows: list[tuple[int, int]], k: int,
           least: np.ndarray, most: np.ndarray) -> list[list[tuple[int, int]]]:
    """Per score window the ``k`` first ``(score, id)``: highest scores, ties by smaller id.

    Rows have the label of the anchor if ``same``, else another; rows with the anchor's own id are never found.
    ``least`` and ``most`` bound the products of each box of the tree. Boxes that only tie with the k-th are opened.
    """
    found: list[list[tuple[int, int]]] = [[] for _ in windows]  # heaps, worst (score, -id) first
    floor = [lo for lo, _ in windows]
    root = len(tree.first) - 1
    queue = [(-most[root], root)]

    def wanted(box: int) -> bool:
        if same and not tree.label_lo[box] <= label <= tree.label_hi[box]:
            return False
        if not same and tree.label_lo[box] == label == tree.label_hi[box]:
            return False
        top, bottom = most[box], least[box]
        return any(top >= f and bottom <= hi for f, (_, hi) in zip(floor, windows))

    while queue:
        _, box = heapq.heappop(queue)
        if not wanted(box):  # the floors may have risen since it was queued
            continue
        a, n = int(tree.first[box]), int(tree.count[box])
        if box >= tree.leaves:
            for child in range(a, a + n):
                if wanted(child):
                    heapq.heappush(queue, (-most[child], child))
            continue
        score = tree.x[a: a + n] @ q
        fits = (tree.labels[a: a + n] == label) == same
        fits &= tree.ids[a: a + n] != own
        fits &= score >= min(floor)
        for i in np.flatnonzero(fits).tolist():
            entry = (int(score[i]), -int(tree.ids[a + i]))
            for w, (_, hi) in enumerate(windows):
                if floor[w] <= entry[0] <= hi:
                    heap = found[w]
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
                    if len(heap) == k:
                        floor[w] = heap[0][0]
    return [[(s, -i) for s, i in sorted(heap, reverse=True)] for heap in found]


def _numbers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.int64)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False) if len(column) else np.zeros(0)
    return np.asarray(flat, np.int64).reshape(len(column), width)


def whole_numbers(vector: Column) -> Column:
    """``floor(256 * x)`` of every component, or null if the vector is null or empty, or a component is null, not finite or too large."""
    scaled = F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    fits = F.forall(vector, lambda x: F.coalesce(F.abs(F.lit(256.0) * x.cast("double")) < F.lit(float(LARGEST)), F.lit(False))
                    & ~F.isnan(x.cast("double")))
    return F.when((F.size(vector) > 0) & fits, scaled)


def _sharded(rows: DataFrame, stage: Stage, shard_rows: int) -> DataFrame:
    """The rows with the number of their shard: ranges of width, label and the coordinate of the largest variance."""
    spread = rows.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.var_pop("x").alias("var"), F.count("*").alias("n"))
    widest = spread.orderBy(F.desc("var"), "at").limit(1).first()
    parts = max(1, -(-(widest["n"] if widest else 0) // shard_rows))
    at = F.get("v", F.lit(widest["at"] if widest else 0))
    return stage(rows.repartitionByRange(parts, "width", "label", at, "vec_id").withColumn("shard", F.spark_partition_id()))


def _boxes(shards: DataFrame) -> DataFrame:
    """One row per shard and width: its box, label range and block of boxes."""

    def box(table: pa.Table) -> pa.Table:
        width = table.column("width")[0].as_py()
        x, labels = _matrix(table.column("v"), width), _numbers(table.column("label"))
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "width": pa.array([width], pa.int32()),
                         "lo": pa.array([x.min(axis=0).tolist()], pa.list_(pa.int64())), "hi": pa.array([x.max(axis=0).tolist()], pa.list_(pa.int64())),
                         "label_lo": pa.array([labels.min()], pa.int64()), "label_hi": pa.array([labels.max()], pa.int64())})

    made = shards.select("shard", "width", "label", "v").groupBy("shard", "width").applyInArrow(
        box, "shard int, width int, lo array<bigint>, hi array<bigint>, label_lo bigint, label_hi bigint")
    return made.groupBy("width", F.floor(F.col("shard") / BOXES).alias("block")).agg(F.collect_list(F.struct(
        "shard", "lo", "hi", "label_lo", "label_hi")).alias("boxes"))  # at most BOXES boxes


def _routes(asked: DataFrame, boxes: DataFrame, same: bool) -> DataFrame:
    """``ask, width, shard, most``: shards whose box holds a fitting label and may hold a product between ``floor`` and ``ceiling``."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            # a batch is cut into runs of one block, so that its boxes are read once
            block = batch.column("block").to_pylist()
            width = batch.column("width").to_pylist()
            cuts = [0, *(i for i in range(1, len(block)) if (block[i], width[i]) != (block[i - 1], width[i - 1])), len(block)]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                told = part.column("boxes")[0].as_py()
                lo, hi = (np.array([t[k] for t in told], np.int64) for k in ("lo", "hi"))
                label_lo, label_hi = (np.array([t[k] for t in told], np.int64) for k in ("label_lo", "label_hi"))
                q = np.array(part.column("v").to_pylist(), np.int64)
                label = _numbers(part.column("label"))[:, None]
                least, most = bounds(q, lo, hi)
                fits = (label_lo <= label) & (label <= label_hi) if same else ~((label_lo == label) & (label == label_hi))
                floor, ceiling = (_numbers(part.column(c))[:, None] for c in ("floor", "ceiling"))
                i, j = np.nonzero(fits & (most >= floor) & (least <= ceiling))
                yield pa.RecordBatch.from_arrays([
                    part.column("ask").take(pa.array(i)), part.column("width").take(pa.array(i)),
                    pa.array(np.array([t["shard"] for t in told], np.int32)[j]), pa.array(most[i, j])], ["ask", "width", "shard", "most"])

    return asked.select("ask", "label", "v", "width", "floor", "ceiling").join(boxes, "width").mapInArrow(
        run, "ask bigint, width int, shard int, most bigint")


def _visited(asked: DataFrame, routes: DataFrame, shards: DataFrame, same: bool, k: int) -> DataFrame:
    """``ask, window, id, score``: the ``k`` first of every window of every ask in every shard it is routed to.

    Asks of one shard are dealt to as many copies of it as keep a group at about ``ASKED`` asks.
    """
    loads = routes.groupBy("shard", "width").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("copies"))
    copy = F.pmod(F.xxhash64("ask"), F.col("copies")).cast("int")
    left = routes.select("ask", "shard", "width").join(loads, ["shard", "width"]).withColumn("copy", copy).drop("copies", "width").join(
        asked.select("ask", "own", "label", "v", "width", "lows", "highs"), "ask")
    right = shards.join(loads, ["shard", "width"]).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")

    def run(asks: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if asks.num_rows and rows.num_rows:
            width = rows.column("width")[0].as_py()
            tree = build(_numbers(rows.column("vec_id")), _numbers(rows.column("label")), _matrix(rows.column("v"), width))
            q = _matrix(asks.column("v"), width)
            if width * int(np.abs(q).max()) * int(np.abs(tree.x).max()) < EXACT:  # products and their sums are exact as doubles, and faster
                q, tree.x, tree.lo, tree.hi = (a.astype(np.float64) for a in (q, tree.x, tree.lo, tree.hi))
            least, most = bounds(q, tree.lo, tree.hi)
            names = ("ask", "own", "label", "lows", "highs")
            for i, (ask, own, label, lows, highs) in enumerate(zip(*(asks.column(c).to_pylist() for c in names))):
                for w, told in enumerate(search(tree, q[i], own, label, same, list(zip(lows, highs)), k, least[i], most[i])):
                    out += [(ask, w, found, score) for score, found in told]
        return pa.table({n: pa.array([r[c] for r in out], t) for c, (n, t) in enumerate(
            [("ask", pa.int64()), ("window", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])})

    keys = ["shard", "width", "copy"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "ask bigint, window int, id bigint, score bigint")


def _first(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("ask", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


WIDE = 1 << 62


def mine(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 50,
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, shard_rows: int = SHARD) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows whose key ``every`` divides.

    Positives are an anchor's first rows of its label, negatives of a positive the first rows of other labels that score
    between ``low`` and ``high`` hundredths of it. Rows with a null key, label or vector, or with a component
    that is null or not finite take no part, nor do empty vectors and components of 65,536 and more in size.
    Equal rows are one; rows that share a key and differ are rows of their own, but never each other's positive or negative.
    Vectors of different lengths do not meet. Anchors without a positive, and positives without a negative, have no row.
    """
    stage = Stage(vectors.sparkSession, "negatives")
    rows = vectors.select(F.col(key).cast("bigint").alias("vec_id"), F.col(label).cast("bigint").alias("label"), whole_numbers(F.col(vector)).alias("v"))
    rows = rows.dropna().distinct().withColumn("width", F.size("v"))
    shards = _sharded(rows, stage, shard_rows)
    boxes = stage(_boxes(shards))
    none, all_ = F.array(F.lit(-WIDE)), F.array(F.lit(WIDE))
    asked = stage(shards.filter(F.pmod(F.col("vec_id"), F.lit(every)) == 0).select(
        F.monotonically_increasing_id().alias("ask"), F.col("vec_id").alias("own"), "label", "v", "width", none.alias("lows"), all_.alias("highs"),
        F.lit(-WIDE).alias("floor"), F.lit(WIDE).alias("ceiling")))

    routes = stage(_routes(asked, boxes, same=True))
    home = routes.groupBy("ask", "width").agg(F.max_by("shard", F.struct("most", "shard")).alias("shard"))
    at_home = stage(_first(_visited(asked, home, shards, True, positives), positives))
    # the k-th best at home: only shards that reach it are asked too
    least = at_home.filter(F.col("rank") == positives).select("ask", F.col("score").alias("least"))
    others = routes.join(home, ["ask", "width", "shard"], "left_anti").join(least, "ask", "left").filter(
        F.col("least").isNull() | (F.col("most") >= F.col("least"))).select("ask", "width", "shard")
    raised = asked.join(least, "ask", "left").withColumn("lows", F.when(F.col("least").isNotNull(), F.array("least")).otherwise(F.col("lows")))
    elsewhere = _visited(raised, others, shards, True, positives)
    names = ["ask", "window", "id", "score"]
    best = stage(_first(at_home.select(*names).union(elsewhere.select(*names)), positives))

    window = F.struct("rank", "id", "score", F.ceil(F.col("score") * low / F.lit(100).cast("decimal(20,0)")).cast("bigint").alias("low"),
                      F.floor(F.col("score") * high / F.lit(100).cast("decimal(20,0)")).cast("bigint").alias("high"))
    exact = best.withColumn("score", F.col("score").cast("decimal(20,0)")).select("ask", window.alias("w")).filter("w.low <= w.high")
    wanted = exact.groupBy("ask").agg(F.array_sort(F.collect_list("w")).alias("w"))  # at most ``positives`` windows
    told = stage(asked.select("ask", "own", "label", "v", "width").join(wanted, "ask").select(
        "*", F.col("w.low").alias("lows"), F.col("w.high").alias("highs"), F.array_min("w.low").alias("floor"), F.array_max("w.high").alias("ceiling")))
    found = _first(_visited(told, _routes(told, boxes, same=False), shards, False, negatives), negatives)
    met = found.join(told.select("ask", "own", "w"), "ask").withColumn("p", F.get("w", F.col("window")))
    return met.select(F.col("own").alias("anchor_id"), F.col("p.id").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
                      F.col("p.score").cast("bigint").alias("positive_score"), F.col("score").alias("negative_score"))


SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
s as (
  select a.vec_id as a, b.vec_id as b, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
p as (select * from s where same qualify row_number() over (partition by a order by score desc, b) <= 5)
select p.a as anchor_id, p.b as positive_id, row_number() over (partition by p.a, p.b order by n.score desc, n.b)::integer as rank,
       n.b as negative_id, p.score as positive_score, n.score as negative_score
from p join s n on n.a = p.a and not n.same and 50 * p.score <= 100 * n.score and 100 * n.score <= 95 * p.score
qualify row_number() over (partition by p.a, p.b order by n.score desc, n.b) <= 3
"""


@query("op12_hard_negatives", SQL)
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every fiftieth vector against the whole table; every seventh label is moved on by one."""
    vectors = read(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", moved))
