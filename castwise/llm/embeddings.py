"""Near-duplicate vectors: robust-pruned flat graphs over overlapping shards, range-expanding greedy search.

1. Equal vectors become one class. The classes of a label are cut into overlapping shards around pivots, again
   and again while a shard is too large; no shard depends on the size of the table.
2. Each shard builds a flat graph by insertion: a member is searched for from the medoids, and of what the search visited
   an edge stays unless a kept neighbour is clearly closer to its end. The adjacency lists of a vector's shards are united.
3. Each shard searches for its members: greedily from the medoids of its parts, then from every member
   found within range on, until no new one is in range. What is found is verified in double precision.

A pair that several shards hold counts in the smallest of them. Shards give counts and the roots of
their own components; links themselves never leave a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from castwise.llm.common import Stage, components, query, read

THRESHOLD = 0.98
CAPACITY = 2_000  # members of a shard
PIVOTS = 16
MARGIN = 0.2  # a vector also goes to its second pivot if that is so little farther away
APART = 0.4  # pivots closer than this are one
DEGREE = 24
ALPHA = 1.2
SAME = 1e-6  # squared distance of vectors in one direction: no edge between them covers another
BEAM = 48  # best members that a search keeps and expands before it follows those in range
EXPANDED = 4  # at a time
FRONTIER = 8_192  # members in range expanded at a time
SLACK = 0.02  # members so little below the threshold are expanded too
BATCH = 256  # searches run together
ROUNDS = 12
SALTS = 16


def usable(vector: Column) -> Column:
    """True for vectors with components, all of them finite, not all of them zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pd.Series, kind=np.float64) -> np.ndarray:
    rows = column.to_numpy() if isinstance(column, pd.Series) else column.to_pylist()
    return np.array([np.asarray(r, kind) for r in rows])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def build_graph(x: np.ndarray, seed: int = 7) -> tuple[np.ndarray, int]:
    """Adjacency ``[n, DEGREE]`` (-1: none) of unit vectors, and how many similarities it took; never all of them.

    Members are inserted in batches that at most double the graph. Each is searched for from the medoids; what the search
    visited, pruned, becomes its edges, which are also made backwards. A second pass does it again on the whole graph.
    """
    n = len(x)
    graph = np.full((n, DEGREE), -1, np.int64)
    if n < 2:
        return graph, 0
    x = x.astype(np.float32)
    heads = medoids(x)
    order = np.concatenate([heads, np.random.default_rng(seed).permutation(np.setdiff1d(np.arange(n), heads))])
    compared = 0
    for whole in (False, True):
        at = 0 if whole else 1
        while at < n:
            batch = order[at: at + (BATCH if whole else min(at, BATCH))]
            visited, met_q, _, _, _ = greedy_search(x, graph, heads if whole else heads[:at], batch)
            compared += len(met_q)
            near = np.concatenate([visited, graph[batch]], axis=1)
            graph[batch] = robust_prune(x, batch, _distinct(np.where(near == batch[:, None], -1, near)))
            _link_back(x, graph, batch)
            at += len(batch)
    return graph, compared


def _mixed(row: np.ndarray, member: np.ndarray) -> np.ndarray:
    """A number below 1 for each pair, so that of many members in one direction each row takes others."""
    return (row * 40_503 ^ member * 2_654_435_761 >> 7) * 2_246_822_519 % 1_000_003 / 1_000_003


def _distinct(candidates: np.ndarray) -> np.ndarray:
    candidates = np.sort(candidates, axis=1)
    again = candidates[:, 1:] == candidates[:, :-1]
    candidates[:, 1:][again] = -1
    return candidates


def _link_back(x: np.ndarray, graph: np.ndarray, batch: np.ndarray) -> None:
    """Give the ends of the batch's edges an edge back; lists that overflow are pruned."""
    row, place = np.nonzero(graph[batch] >= 0)
    source = batch[row]
    target = graph[source, place]
    new = ~(graph[target] == source[:, None]).any(axis=1)
    source, target = source[new], target[new]
    if not len(target):
        return
    order = np.lexsort((-np.einsum("nd,nd->n", x[source], x[target]), target))
    source, target = source[order], target[order]
    place = np.arange(len(target)) - np.searchsorted(target, target, side="left")
    near = place < 2 * DEGREE  # only the closest of very many could stay
    source, target, place = source[near], target[near], place[near]
    ends, at = np.unique(target, return_inverse=True)
    lists = np.full((len(ends), DEGREE + place.max() + 1), -1, np.int64)
    lists[:, :DEGREE] = graph[ends]
    lists[at, DEGREE + place] = source
    full = (lists >= 0).sum(axis=1) > DEGREE
    graph[ends[~full]] = -np.sort(-lists[~full], axis=1)[:, :DEGREE]
    if full.any():
        graph[ends[full]] = robust_prune(x, ends[full], lists[full])


def robust_prune(x: np.ndarray, rows: np.ndarray, near: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Kept of the candidates ``near [row, candidate]`` (-1: none) of the given rows of ``x``, nearest first, as ``[row, degree]``.

    The nearest candidate is kept and all those are dropped that are ``alpha`` times closer to it than to the row; and so on.
    """
    ends = x[np.maximum(near, 0)]
    to_row = np.where(near >= 0, np.maximum(0, 2 - 2 * np.einsum("nd,nmd->nm", x[rows], ends)), np.inf)
    order = np.argsort(to_row + _mixed(rows[:, None], np.maximum(near, 0)) * SAME, axis=1, kind="stable")
    near, to_row = np.take_along_axis(near, order, 1), np.take_along_axis(to_row, order, 1)
    ends = np.take_along_axis(ends, order[:, :, None], 1)
    alive = np.isfinite(to_row)
    out, at = np.full((len(rows), degree), -1, np.int64), np.arange(len(rows))
    for k in range(min(degree, near.shape[1])):
        best = np.argmax(alive, axis=1)
        ok = alive[at, best]
        if not ok.any():
            break
        out[ok, k] = near[at[ok], best[ok]]
        to_best = np.maximum(0, 2 - 2 * np.einsum("nd,nmd->nm", ends[at, best], ends))
        alive &= ~((alpha**2 * to_best <= to_row) & ok[:, None] & (to_row > SAME))
        alive[at[ok], best[ok]] = False
    return out


def medoids(x: np.ndarray, parts: int = 32, seed: int = 11) -> np.ndarray:
    """The member nearest to the mean of all, and to the mean of every part around random members."""
    random = np.random.default_rng(seed)
    pivots = random.choice(len(x), min(parts, len(x)), replace=False)
    part = np.argmax(x @ x[pivots].T, axis=1)
    found = [int(np.argmax(x @ x.mean(axis=0)))]
    for p in np.unique(part):
        mine = np.flatnonzero(part == p)
        found.append(int(mine[np.argmax(x[mine] @ x[mine].mean(axis=0))]))
    return np.unique(found)


def greedy_search(x: np.ndarray, graph: np.ndarray, starts: np.ndarray, queries: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, ...]:
    """Searches for members ``queries`` of ``x`` run together: each keeps the ``beam`` best it met and expands them until all are.

    Gives the expanded members ``[query, step]`` (-1: none), then ``query, member, similarity`` of every member met, once
    each, and the table ``[query, member]`` of what was met.
    """
    count, first = len(queries), len(starts)
    near = np.full((count, beam + first), -1, np.int64)
    near[:, :first] = starts
    sims = np.full(near.shape, -np.inf, np.float32)
    sims[:, :first] = x[queries] @ x[starts].T
    fresh = near >= 0
    seen = np.zeros((count, len(x)), bool)
    seen[:, starts] = True
    met = [(np.repeat(np.arange(count), first), np.tile(starts, count), sims[:, :first].ravel())]
    visited, active = [np.zeros((count, 0), np.int64)], np.arange(count)
    while True:
        best = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
        near, sims, fresh = (np.take_along_axis(v, best, 1) for v in (near, sims, fresh))
        value = np.where(fresh, sims, -np.inf)
        top = np.argpartition(-value, EXPANDED - 1, axis=1)[:, :EXPANDED]
        go = np.isfinite(np.take_along_axis(value, top, 1))
        live = go.any(axis=1)
        if not live.any():
            break
        near, sims, fresh, active, top, go = (v[live] for v in (near, sims, fresh, active, top, go))
        chosen = np.where(go, np.take_along_axis(near, top, 1), -1)
        np.put_along_axis(fresh, top, False, 1)
        visited.append(np.full((count, EXPANDED), -1, np.int64))
        visited[-1][active] = chosen
        ends = _distinct(np.where(go[:, :, None], graph[np.maximum(chosen, 0)], -1).reshape(len(active), -1))
        new = (ends >= 0) & ~seen[active[:, None], np.maximum(ends, 0)]
        row, place = np.nonzero(new)
        q, e = active[row], ends[row, place]
        seen[q, e] = True
        found = np.full(ends.shape, -np.inf, np.float32)
        sim = np.einsum("nd,nd->n", x[queries[q]], x[e])
        found[row, place] = sim + _mixed(queries[q], e) * SAME
        met.append((q, e, sim))
        near, sims, fresh = np.hstack([near, ends]), np.hstack([sims, found]), np.hstack([fresh, new])
    return np.hstack(visited), *(np.concatenate(v) for v in zip(*met)), seen


def range_search(x: np.ndarray, graph: np.ndarray, starts: np.ndarray, queries: np.ndarray, threshold: float,
                 beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, int]:
    """``(query, member)`` of the members met within ``threshold`` (a little below it) of each query, itself left out, and
    how many similarities it took.

    A greedy search from ``starts``; then all members in range are expanded, and those in range next to them, until none is left.
    """
    x, n, compared = x.astype(np.float32), len(x), 0
    found_q, found_x = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s in range(0, len(queries), BATCH):
        batch = queries[s: s + BATCH]
        _, q, e, sim, seen = greedy_search(x, graph, starts, batch, beam)
        while len(q):
            compared += len(q)
            hit = (sim >= threshold - 1e-3) & (batch[q] != e)
            found_q.append(batch[q[hit]])
            found_x.append(e[hit])
            wide = sim >= threshold - SLACK
            from_q, from_e, after = q[wide], e[wide], []
            for part in range(0, len(from_q), FRONTIER):
                ends = graph[from_e[part: part + FRONTIER]]
                row, place = np.nonzero(ends >= 0)
                pair = from_q[part + row] * n + ends[row, place]
                pair = np.unique(pair[~seen.reshape(-1)[pair]])
                seen.reshape(-1)[pair] = True
                after.append((pair // n, pair % n, np.einsum("nd,nd->n", x[batch[pair // n]], x[pair % n])))
            q, e, sim = (np.concatenate(v) for v in zip(*after)) if after else (np.zeros(0, np.int64),) * 3
    return np.concatenate(found_q), np.concatenate(found_x), compared


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place reachable over the links, for every place."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def _shards(classes: DataFrame, stage: Stage, capacity: int) -> DataFrame:
    """``node, shard`` of every class; a class may be in several shards, none of them above about twice the capacity."""
    now = stage(classes.select("node", "vector", F.xxhash64("label", F.size("vector")).alias("shard"), F.lit(False).alias("crowded")))
    for _ in range(ROUNDS):
        sizes = now.filter(~F.col("crowded")).groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > capacity)
        large = stage(sizes.select("shard"))
        if large.isEmpty():
            break
        # a fixed number of pivots per large shard, dealt to every salt of it
        by_hash = Window.partitionBy("shard").orderBy(F.xxhash64("node"), "node")
        pivots = (now.join(large, "shard").select("shard", "node", "vector").withColumn("n", F.row_number().over(by_hash))
                  .filter(F.col("n") <= PIVOTS).groupBy("shard").agg(F.collect_list(F.struct("n", "vector")).alias("p")))
        pivots = pivots.select("shard", F.transform(F.array_sort("p"), lambda p: p["vector"]).alias("pivots"),
                               F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))

        @F.pandas_udf("array<int>")
        def nearest(vector: pd.Series, shard: pd.Series, pivot: pd.Series) -> pd.Series:
            out = [None] * len(vector)
            unit = _unit(_matrix(vector))
            for rows in shard.groupby(shard.to_numpy()).groups.values():
                rows = np.asarray(rows)
                p = _unit(_matrix(pd.Series([v for v in pivot.iloc[rows[0]]])))
                kept: list[int] = []
                for i in range(len(p)):
                    if all(2 - 2 * p[i] @ p[j] > APART**2 for j in kept):
                        kept.append(i)
                far = np.sqrt(np.maximum(0, 2 - 2 * unit[rows] @ p[kept].T))
                order = np.argsort(far, axis=1, kind="stable")
                for i, r in enumerate(rows):
                    a = order[i, 0]
                    also = len(kept) > 1 and far[i, order[i, 1]] <= far[i, a] + MARGIN
                    # one pivot cannot split the shard
                    out[r] = [-1] if len(kept) == 1 else [int(kept[a]), int(kept[order[i, 1]])] if also else [int(kept[a])]
            return pd.Series(out)

        salted = now.join(large, "shard", "left_semi").withColumn("salt", F.pmod(F.xxhash64("node", F.lit("salt")), F.lit(SALTS)).cast("int"))
        dealt = salted.join(pivots, ["shard", "salt"]).withColumn("to", F.explode(nearest("vector", "shard", "pivots")))
        split = dealt.select("node", "vector", F.when(F.col("to") < 0, F.col("shard")).otherwise(F.xxhash64("shard", "to")).alias("shard"),
                             (F.col("to") < 0).alias("crowded"))
        rest = now.filter("crowded").union(now.filter(~F.col("crowded")).join(large, "shard", "left_anti").select(*now.columns))
        after = stage(rest.unionByName(split))
        stage.drop(now, large)
        now = after
    # a ball of vectors that no pivots split: its blocks meet two by two, for its links are that many
    sizes = now.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * capacity).select(
        "shard", F.ceil(F.col("n") / capacity).cast("int").alias("blocks"))
    placed = now.select("node", "shard").join(sizes, "shard", "left").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = placed.withColumn("other", other)
    pair = F.xxhash64("shard", F.least("block", "other"), F.greatest("block", "other"))
    return stage(met.select("node", F.when(F.col("blocks").isNull(), F.col("shard")).otherwise(pair).alias("shard")).distinct())


def linked(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD,
           capacity: int = CAPACITY) -> DataFrame:
    """One row per row of ``vectors``: ``key, n_links, component_id, kept``.

    Rows link if their labels are equal and not null and the cosine of their vectors is at least
    ``threshold``; links may be missed by the search (``audit`` measures how many), none below the threshold is made. Vectors that are
    null, empty, zero or not finite link with nothing, nor do vectors of different lengths. Repeated rows are
    rows of their own: they link with each other. A null key never names a component; a component without a key is null and its rows are kept.
    """
    stage = Stage(vectors.sparkSession, "embeddings")
    one = F.transform(F.col(vector), lambda v: v.cast("double"))
    rows = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.when(usable(one) & F.col(label).isNotNull(), one).alias("vector"))
    rows = rows.withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit("again"), "vector"))
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()))
    same = ["label", "h1", "h2"]
    grouped = rows.filter(F.col("vector").isNotNull()).groupBy(*same).agg(
        F.min("key").alias("first"), F.count("*").alias("copies"), F.min_by("vector", "row").alias("vector"))
    classes = stage(grouped.withColumn("node", F.monotonically_increasing_id()))

    member = _shards(classes, stage, capacity)
    lists = member.groupBy("node").agg(F.sort_array(F.collect_set("shard")).alias("shards"))
    placed = stage(member.join(classes.select("node", "vector", "copies"), "node").join(lists, "node"))

    def graph_of(table: pa.Table) -> pa.Table:
        node = np.array(table.column("node").to_pylist(), np.int64)
        order = np.argsort(node)
        node = node[order]
        out, _ = build_graph(_unit(_matrix(table.column("vector"))[order]))
        return pa.table({"node": node, "ends": pa.array([node[r[r >= 0]].tolist() for r in out], pa.list_(pa.int64()))})

    edges = placed.select("shard", "node", "vector").groupBy("shard").applyInArrow(graph_of, "node bigint, ends array<bigint>")
    united = edges.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("ends"))).alias("ends"))

    def search(table: pa.Table) -> pa.Table:
        node = np.array(table.column("node").to_pylist(), np.int64)
        order = np.argsort(node)
        node = node[order]
        shard = table.column("shard")[0].as_py()
        unit = _unit(_matrix(table.column("vector"))[order])
        copies = np.array(table.column("copies").to_pylist(), np.int64)[order]
        ends, shards = table.column("ends").to_pylist(), table.column("shards").to_pylist()
        ends, shards = [ends[i] for i in order], [shards[i] for i in order]
        graph = np.full((len(node), max(1, max(len(e) for e in ends))), -1, np.int64)
        for i, e in enumerate(ends):
            at = np.searchsorted(node, e)
            at = at[(at < len(node)) & (node[np.minimum(at, len(node) - 1)] == e)] if len(e) else np.zeros(0, np.int64)
            graph[i, : len(at)] = at
        q, x, _ = range_search(unit, graph, medoids(unit.astype(np.float32)), np.arange(len(node)), threshold)
        # each link once and both ways, whoever found it
        low, high = np.minimum(q, x), np.maximum(q, x)
        pair = np.unique(low * len(node) + high)
        a, b = pair // len(node), pair % len(node)
        exact = np.concatenate([np.einsum("nd,nd->n", unit[a[s: s + 65536]], unit[b[s: s + 65536]]) for s in range(0, len(a), 65536)] or [np.zeros(0)])
        a, b = a[exact >= threshold], b[exact >= threshold]
        several = {i for i, s in enumerate(shards) if len(s) > 1}
        mine = np.ones(len(a), bool)
        for i, (u, v) in enumerate(zip(a.tolist(), b.tolist())):
            if u in several and v in several:
                mine[i] = min(set(shards[u]) & set(shards[v])) == shard
        links = np.bincount(a[mine], copies[b[mine]], len(node)) + np.bincount(b[mine], copies[a[mine]], len(node))
        root = local_roots(len(node), a, b)
        return pa.table({"node": node, "links": links.astype(np.int64), "root": node[root]})

    found = stage(placed.join(united, "node").groupBy("shard").applyInArrow(search, "node bigint, links bigint, root bigint"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.filter("root <> node").select(F.col("root").alias("a"), F.col("node").alias("b")), stage)
    named = classes.select("node", *same, "first", "copies").join(counts, "node", "left").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    told = named.join(least, "root").select(
        *same, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.drop("vector").join(told, same, "left")
    lone = F.col("n_links").isNull()
    component = F.when(lone, F.col("key")).otherwise(F.col("component_id"))
    return out.select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))


def audit(vectors: DataFrame, result: DataFrame, every: int = 50, key: str = "vec_id", vector: str = "embedding",
          label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row ``found, true, recall``: links of the rows whose key is divisible by ``every``, against all rows by brute force.

    The queries are dealt out in blocks of a fixed size, each of which meets all rows once.
    """
    usable_rows = vectors.filter(usable(F.transform(F.col(vector), lambda v: v.cast("double"))) & F.col(label).isNotNull()).select(
        F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    asked = usable_rows.filter(F.pmod(F.col("key"), F.lit(every)) == 0).groupBy(
        "label", F.size("vector").alias("width"), F.pmod(F.xxhash64("key"), F.lit(64)).alias("block")).agg(
        F.collect_list(F.struct("key", "vector")).alias("asked"))

    @F.pandas_udf("array<bigint>")
    def in_range(vector: pd.Series, own: pd.Series, asked_of: pd.Series) -> pd.Series:
        unit, out = _unit(_matrix(vector)), []
        cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for u, k, a in zip(unit, own, asked_of):
            if id(a) not in cache:
                cache[id(a)] = np.array([r["key"] for r in a]), _unit(np.array([np.asarray(r["vector"], float) for r in a]))
            keys, other = cache[id(a)]
            out.append(keys[(other @ u >= threshold) & (keys != k)].tolist())
        return pd.Series(out)

    met = usable_rows.withColumn("width", F.size("vector")).join(asked, ["label", "width"])
    truth = met.select(F.explode(in_range("vector", "key", "asked")).alias("key")).groupBy("key").agg(F.count("*").alias("true"))
    told = result.filter(F.pmod(F.col(key), F.lit(every)) == 0).select(F.col(key).alias("key"), "n_links")
    both = told.join(truth, "key", "left").agg(
        F.coalesce(F.sum("n_links"), F.lit(0)).alias("found"), F.coalesce(F.sum("true"), F.lit(0)).alias("true"))
    return both.withColumn("recall", F.when(F.col("true") > 0, F.col("found") / F.col("true")).otherwise(1.0))


@query("op4_embeddings")
def op4_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate vectors within the labels of the whole table."""
    return linked(read(spark, folder, "embeddings"))
