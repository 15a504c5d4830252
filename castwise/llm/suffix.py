"""Exact substring deduplication: interval expansion on a Burrows-Wheeler transform, bounded by the length asked for.

A suffix array over all texts would be several times the corpus. Here only the places that can repeat
are gathered. Every string of ``length`` bytes contains a smallest hashed gram; equal strings have equal ones.
Consecutive strings with the same smallest gram form a run, and its bytes are the run's context:

1. ``_runs`` finds the runs of every text, ``_gather`` brings together those with one gram. Contexts
   seen in a smaller document are removed at once; a gram with one context is done.
2. The few contexts that share a gram but differ elsewhere are cut from their texts and put into a
   Burrows-Wheeler transform per bucket of grams (``repeats``), where intervals of equal prefixes are
   extended backward, breadth first, from short to ``length`` bytes; intervals of one document end early.
3. ``strip`` removes what was found from the texts.

Runs travel as byte planes of whole arrays (``_pack``), which takes a third of the space of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castwise.llm.common import free_name, query, read, shard_of, Stage, utf8

LENGTH = 50
GRAM = 24
SEED = 32  # intervals start at this length, read off the sorted ranks
LONGEST_RUN = 4096  # strings in a run; longer ones (periodic texts) are cut
BUCKET_BYTES = 2 << 20  # text per bucket of grams and per shard of documents
TRANSFORM_BYTES = 1 << 20  # contexts put into one transform, about; a gram with more has one of its own
CROWDED = 6 << 20  # bytes of contexts of one gram beyond which its strings are compared one by one, by hash
BASE = np.uint64(0x9E3779B97F4A7C15)

_POWERS: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * BASE)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS["up"]) <= n:
        size = max(n + 1, 1 << 16)
        for name, base in (("up", int(BASE)), ("down", pow(int(BASE), -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def _gram_hashes(values: np.ndarray, gram: int) -> np.ndarray:
    """Polynomial hash of the ``gram`` values from every place on, by doubling."""
    done, width, power, level = None, 0, 1, values
    while power <= gram:
        if gram & power:
            n = len(values) - width - power + 1
            done = level[:n] if done is None else done[:n] * np.uint64(pow(int(BASE), power, 1 << 64)) + level[width: width + n]
            width += power
        level = level[:-power] * np.uint64(pow(int(BASE), power, 1 << 64)) + level[power:]
        power *= 2
    return done


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def _runs(data: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram, context hash (48 bits), first string and number of strings of every run of a text."""
    raw = np.frombuffer(data, np.uint8)
    values = _BYTES[raw]
    least = _sliding_min(_mix(_gram_hashes(values, gram)), length - gram + 1)
    start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    end = np.append(start[1:], len(least))
    if (end - start).max() > LONGEST_RUN:
        cuts = [np.arange(s, e, LONGEST_RUN) for s, e in zip(start, end)]
        start = np.concatenate(cuts)
        end = np.append(start[1:], len(least))
    up, down = _powers(len(raw))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(raw)], dtype=np.uint64)])
    context = (total[end + length - 1] - total[start]) * down[start]
    count = (end - start).astype(np.uint64)
    return _mix(least[start] + np.uint64(1)), _mix(context + count * BASE) >> np.uint64(16), start, end - start


def _pack(x: np.ndarray, kind: str) -> bytes:
    """An array as byte planes: planes of high bytes are mostly zero and cost nothing once compressed."""
    x = np.ascontiguousarray(x.astype(kind))
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _unpack(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


RUN_KINDS = {"gram": "<u8", "context": "<u8", "doc": "<i8", "tag": "<i8", "start": "<u4", "count": "<u4"}
RUNS = "bucket int, mark boolean, " + ", ".join(f"{c} binary" for c in RUN_KINDS)
SPAN_KINDS = {"gram": "<u8", "doc": "<i8", "tag": "<i8", "start": "<u4", "end": "<u4"}
SPANS = "kind int, shard int, " + ", ".join(f"{c} binary" for c in SPAN_KINDS)


def _bucket(gram: np.ndarray, buckets: int) -> np.ndarray:
    return ((gram >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _columns(table: pa.Table | pa.RecordBatch, kinds: dict[str, str]) -> dict[str, np.ndarray]:
    return {c: np.concatenate([np.zeros(0, k), *(_unpack(b.as_py(), k) for b in table.column(c))]) for c, k in kinds.items()}


def _spans(kind: int, found: dict[str, np.ndarray], shards: int) -> Iterator[dict]:
    """Rows of packed spans, one per shard of documents."""
    shard = shard_of(found["doc"], shards)
    order = np.argsort(shard, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
        if len(part):
            yield {"kind": kind, "shard": int(shard[part[0]]), **{c: _pack(found[c][part], k) for c, k in SPAN_KINDS.items()}}


def _span_table(rows: list[dict]) -> pa.Table:
    types = [("kind", pa.int32()), ("shard", pa.int32()), *((c, pa.binary()) for c in SPAN_KINDS)]
    return pa.Table.from_pylist(rows, pa.schema(types))


def _find_runs(docs: DataFrame, length: int, gram: int, buckets: int, tagged: bool) -> DataFrame:
    """Packed runs of all texts (``doc, data``) by bucket of grams.

    Of equal contexts in a few megabytes of text only the smallest document's go on; the others are known
    to repeat (``mark``). So a text with very many copies sends one of them at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some, size = [], 0
            for doc, data in zip(batch.column("doc").to_pylist(), batch.column("data")):
                if doc is not None:
                    some.append((doc, data.as_py()))
                    size += len(some[-1][1])
                if size > BUCKET_BYTES:
                    yield from packed(some)
                    some, size = [], 0
            yield from packed(some)

    def packed(some: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        parts = []
        for doc, data in sorted(some, key=lambda x: x[0]):
            if len(data) >= length:
                gram_, context, start, count = _runs(data, length, gram)
                tag = _tag(data) if tagged else 0
                parts.append((gram_, context, np.full(len(start), doc), np.full(len(start), tag), start, count))
        if not parts:
            return
        r = {c: np.concatenate(x) for c, x in zip(RUN_KINDS, zip(*parts))}
        same = _mix(r["gram"] ^ (r["context"] * BASE))
        order = np.argsort(same, kind="stable")  # the texts come by ascending id: the first is the smallest
        first = np.concatenate([[True], same[order][1:] != same[order][:-1]])
        least = r["doc"][order][first][np.cumsum(first) - 1]
        later = np.zeros(len(order), bool)
        later[order] = r["doc"][order] != least
        mine = np.flatnonzero(~later)
        mine = mine[np.argsort(r["gram"][mine])]
        yield from rows(False, {c: x[mine] for c, x in r.items()}, _bucket(r["gram"][mine], buckets))
        # neighbouring runs that repeat are one span
        mine = np.flatnonzero(later)
        if len(mine):
            apart = (np.diff(mine) != 1) | (r["start"][mine[1:]] != r["start"][mine[:-1]] + r["count"][mine[:-1]])
            at = np.flatnonzero(np.concatenate([[True], apart]))
            spans = {c: x[mine[at]] for c, x in r.items()}
            spans["count"] = np.add.reduceat(r["count"][mine], at)
            bucket = shard_of(spans["doc"], buckets)
            order = np.argsort(bucket, kind="stable")
            yield from rows(True, {c: x[order] for c, x in spans.items()}, bucket[order])

    def rows(mark: bool, r: dict[str, np.ndarray], bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = [c for c in np.split(np.arange(len(bucket)), np.flatnonzero(np.diff(bucket.astype(np.int64))) + 1) if len(c)]
        if cuts:
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(bucket[c[0]]) for c in cuts], pa.int32()), pa.array([mark] * len(cuts)),
                 *(pa.array([_pack(r[c][x], k) for x in cuts], pa.binary()) for c, k in RUN_KINDS.items())],
                ["bucket", "mark", *RUN_KINDS])

    return docs.mapInArrow(run, RUNS)


def _gather(table: pa.Table, length: int, shards: int) -> pa.Table:
    """What the runs of one bucket tell: kind 0, spans that repeat; 1, contexts to compare; 2, contexts of crowded grams."""
    known = table.filter(table.column("mark"))
    rows = []
    if known.num_rows:
        r = _columns(known, RUN_KINDS)
        rows += _spans(0, {**r, "end": r["start"] + r["count"] + length - 1}, shards)
    r = _columns(table.filter(pc.invert(table.column("mark"))), RUN_KINDS)
    if len(r["doc"]):
        order = np.lexsort((r["doc"], r["context"], r["gram"]))
        r = {c: x[order] for c, x in r.items()}
        r["end"] = r["start"] + r["count"] + length - 1
        new_gram = np.concatenate([[True], r["gram"][1:] != r["gram"][:-1]])
        new_context = new_gram | np.concatenate([[True], (r["context"][1:] != r["context"][:-1]) | (r["count"][1:] != r["count"][:-1])])
        least = r["doc"][new_context][np.cumsum(new_context) - 1]
        repeated = r["doc"] != least
        rows += _spans(0, {c: r[c][repeated] for c in SPAN_KINDS}, shards)
        at = np.flatnonzero(new_gram)
        group = np.cumsum(new_gram) - 1
        several = np.minimum.reduceat(least, at) != np.maximum.reduceat(least, at)
        left = several[group] & ~repeated
        size = np.add.reduceat(np.where(left, r["end"] - r["start"], 0).astype(np.int64), at)
        crowded = size[group] > CROWDED
        rows += _spans(1, {c: r[c][left & ~crowded] for c in SPAN_KINDS}, shards)
        rows += _spans(2, {c: r[c][left & crowded] for c in SPAN_KINDS}, shards)
    return _span_table(rows)


def _tag(data: bytes) -> int:
    """63 bits that tell the texts of a repeated id apart."""
    return xxhash.xxh64_intdigest(data) >> 1


def _texts(left: pa.Table, tagged: bool) -> Iterator[tuple[int | None, int, bytes]]:
    """Id, tag and bytes of every row; the last columns are id, bytes and shard."""
    for doc, data in zip(left.column(left.num_columns - 3).to_pylist(), left.column(left.num_columns - 2)):
        raw = data.as_py()
        yield doc, _tag(raw) if tagged else 0, raw


def _by_document(found: dict[str, np.ndarray]) -> dict[tuple[int, int], np.ndarray]:
    """Places of the spans of every (doc, tag)."""
    order = np.lexsort((found["start"], found["tag"], found["doc"]))
    doc, tag = found["doc"][order], found["tag"][order]
    cuts = np.flatnonzero((np.diff(doc) != 0) | (tag[1:] != tag[:-1])) + 1
    return {(int(found["doc"][x[0]]), int(found["tag"][x[0]])): x for x in np.split(order, cuts) if len(x)}


CONTEXT_KINDS = {"gram": "<u8", "doc": "<i8", "tag": "<i8", "start": "<u4", "size": "<u4"}
CONTEXTS = "bucket int, " + ", ".join(f"{c} binary" for c in (*CONTEXT_KINDS, "data"))


def _cut_contexts(left: pa.Table, right: pa.Table, buckets: int, tagged: bool) -> pa.Table:
    """The bytes of the contexts to compare, by bucket of grams."""
    out: dict[int, list[tuple[int, int, int, int, bytes]]] = {}
    if right.num_rows:
        found = _columns(right, SPAN_KINDS)
        places = _by_document(found)
        where = _bucket(found["gram"], buckets)
        for doc, tag, data in _texts(left, tagged):
            for i in places.get((doc, tag), ()):
                start = int(found["start"][i])
                out.setdefault(int(where[i]), []).append((int(found["gram"][i]), doc, tag, start, data[start: int(found["end"][i])]))
    rows = []
    for bucket, cut in out.items():
        *numbers, data = zip(*cut)
        numbers.append([len(x) for x in data])
        packed = {c: _pack(np.array(x, k), k) for (c, k), x in zip(CONTEXT_KINDS.items(), numbers)}
        rows.append({"bucket": bucket, **packed, "data": b"".join(data)})
    return pa.Table.from_pylist(rows, pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in (*CONTEXT_KINDS, "data"))]))


def suffix_order(text: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of 16-bit symbols sorted by at least their first ``reach``, and ranks by the first ``SEED``; prefix doubling from four symbols on."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(4, np.uint16)])
    key = padded[:n].astype(np.uint64)
    for i in range(1, 4):
        key <<= np.uint64(16)
        key |= padded[i: n + i]
    width, seeds = 4, None
    while True:
        order = np.argsort(key, kind="stable").astype(np.int32)
        ordered = key[order]
        rank = np.empty(n, np.uint32)
        rank[order] = np.cumsum(np.concatenate([[True], ordered[1:] != ordered[:-1]]), dtype=np.uint32)
        del ordered
        if width == SEED:
            seeds = rank
        if width >= max(reach, SEED):
            return order, seeds
        key = rank.astype(np.uint64)
        key <<= np.uint64(32)
        if n > width:
            key[:-width] |= rank[width:]
        width *= 2


def repeats(doc: np.ndarray, size: np.ndarray, data: bytes, length: int) -> np.ndarray:
    """Places in ``data`` (contexts of ``size`` bytes joined) of strings that also start in a smaller document.

    The contexts get separators and are transformed: ``before[row]`` is the row of the suffix one place
    further left, whose symbol is the transform's. Intervals are runs of rows with one label; a level
    replaces every row by the one before it and splits intervals by the symbol gained. Rows behind a
    separator leave, and intervals whose rows are all of one document are dropped.
    """
    n = len(data) + len(size)
    text = np.zeros(n, np.uint16)
    ends = np.cumsum(size.astype(np.int64) + 1) - 1  # places of the separators
    inside = np.ones(n, bool)
    inside[ends] = False
    text[inside] = np.frombuffer(data, np.uint8)
    text[inside] += 1
    owner = np.repeat(np.arange(len(size), dtype=np.int32), size.astype(np.int64) + 1)
    order, seed_rank = suffix_order(text, length)
    row_of = np.empty(n, np.int32)
    row_of[order] = np.arange(n, dtype=np.int32)
    before = row_of[order - 1]
    gained = np.where(order > 0, text[order - 1], np.uint16(0))
    row_doc = np.unique(doc, return_inverse=True)[1].astype(np.int32)[owner[order]]  # ids by their order are all that matters
    row_text = text[order]

    rows = np.flatnonzero(order + SEED <= ends[owner[order]])
    label = seed_rank[order[rows]].astype(np.int64)
    edge = np.concatenate([[True], label[1:] != label[:-1]]) if len(rows) else np.zeros(0, bool)
    slot = np.full(n, -1, np.int32)
    level = SEED
    while len(rows):
        starts = np.flatnonzero(edge)
        number = np.cumsum(edge) - 1
        docs = row_doc[rows]
        mixed = np.minimum.reduceat(docs, starts) != np.maximum.reduceat(docs, starts)
        kept = mixed[number]
        rows, number = rows[kept], number[kept]
        if level == length or not len(rows):
            break
        go = gained[rows] != 0
        target = before[rows[go]]
        slot[target] = number[go]
        rows = np.sort(target)
        label, symbol = slot[rows], row_text[rows]
        slot[target] = -1
        edge = np.concatenate([[True], (label[1:] != label[:-1]) | (symbol[1:] != symbol[:-1])]) if len(rows) else np.zeros(0, bool)
        level += 1
    if not len(rows):
        return np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    least = np.repeat(np.minimum.reduceat(row_doc[rows], starts), np.diff(np.append(starts, len(rows))))
    place = order[rows[row_doc[rows] != least]]
    return np.sort(place - owner[place])  # without the separators in front


def _compare(table: pa.Table, length: int, shards: int) -> pa.Table:
    """Repeated spans of the contexts of one bucket. Grams do not meet, so each transform takes a few of them."""
    c = _columns(table, CONTEXT_KINDS)
    data = b"".join(x.as_py() for x in table.column("data"))
    end = np.cumsum(c["size"].astype(np.int64))
    order = np.argsort(c["gram"], kind="stable")
    gram, size = c["gram"][order], c["size"][order].astype(np.int64)
    edges = np.append(np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])), len(gram))
    total = np.concatenate([[0], np.cumsum(size)])
    rows, first = [], 0
    for i in range(1, len(edges)):
        if i + 1 == len(edges) or total[edges[i + 1]] - total[edges[first]] > TRANSFORM_BYTES:
            some = order[edges[first]: edges[i]]
            first = i
            rows += _spans(0, _repeated_spans({k: x[some] for k, x in c.items()}, b"".join([data[end[j] - c["size"][j]: end[j]] for j in some]), length), shards)
    return _span_table(rows)


def _repeated_spans(c: dict[str, np.ndarray], data: bytes, length: int) -> dict[str, np.ndarray]:
    place = repeats(c["doc"], c["size"], data, length)
    if not len(place):
        return {k: np.zeros(0, kind) for k, kind in SPAN_KINDS.items()}
    begin = np.cumsum(c["size"].astype(np.int64)) - c["size"]
    owner = np.searchsorted(begin, place, side="right") - 1
    fresh = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 1) | (np.diff(owner) != 0)]))
    first, last, who = place[fresh], place[np.append(fresh[1:], len(place)) - 1], owner[fresh]
    start = c["start"][who] + (first - begin[who])
    return {"gram": c["gram"][who], "doc": c["doc"][who], "tag": c["tag"][who], "start": start, "end": start + (last - first) + length}


def _strings(left: pa.Table, right: pa.Table, length: int, tagged: bool) -> pa.Table:
    """Every single string of the contexts of crowded grams, as two hashes with its place."""
    h, doc_, tag_, at = [], [], [], []
    if right.num_rows:
        found = _columns(right, SPAN_KINDS)
        places = _by_document(found)
        for doc, tag, data in _texts(left, tagged):
            for i in places.get((doc, tag), ()):
                for start in range(int(found["start"][i]), int(found["end"][i]) - length + 1):
                    h.append(xxhash.xxh3_128_digest(data[start: start + length]))
                    doc_.append(doc)
                    tag_.append(tag)
                    at.append(start)
    return pa.table({"string": pa.array(h, pa.binary()), "doc": pa.array(doc_, pa.int64()), "tag": pa.array(tag_, pa.int64()), "start": pa.array(at, pa.int64())})


def _merged(spans: np.ndarray, found: dict[str, np.ndarray]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans, given by ascending start."""
    if not len(spans):
        return []
    start, end = found["start"][spans].astype(np.int64), np.maximum.accumulate(found["end"][spans].astype(np.int64))
    fresh = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    return list(zip(start[fresh].tolist(), end[np.append(fresh[1:], len(end)) - 1].tolist()))


def _remove(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in runs:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


def strip(docs: DataFrame, found: DataFrame, columns: str, make: Callable, tagged: bool) -> DataFrame:
    """Cogroups sharded texts with their spans: ``make(table, runs per row)`` gives the columns of the result."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        spans = _columns(right, SPAN_KINDS)
        places = _by_document(spans) if right.num_rows else {}
        runs = [(data, _merged(places.get((doc, tag), np.zeros(0, np.int64)), spans)) for doc, tag, data in _texts(left, tagged)]
        return make(left, runs)

    return docs.groupBy(docs.columns[-1]).cogroup(found.groupBy("shard")).applyInArrow(run, columns)


def _removal(docs: DataFrame, key: str, text: str, columns: str, make: Callable, length: int, gram: int) -> DataFrame:
    if not gram <= SEED <= length:
        raise ValueError(f"grams of {gram} bytes, seeds of {SEED} and a length of {length} do not fit")
    stage = Stage(docs.sparkSession, "suffix")
    data = utf8(F.col(text))
    size = docs.agg(F.coalesce(F.sum(F.length(data)), F.lit(0))).first()[0]
    parts = max(16, -(-size // BUCKET_BYTES))
    # repeated ids need their text's hash beside them; an id is otherwise enough
    tagged = not docs.groupBy(key).count().filter("count > 1").limit(1).isEmpty()

    bare = docs.select(F.col(key).cast("bigint").alias("doc"), data.alias("data"))
    runs = _find_runs(bare, length, gram, parts, tagged)
    told = stage(runs.groupBy("bucket").applyInArrow(lambda t: _gather(t, length, parts), SPANS))

    # rows without an id have no spans and may be in any shard
    number = F.col(key).cast("bigint")
    shard = F.pmod(F.when(number.isNotNull(), F.xxhash64(number)).otherwise(F.xxhash64(data)), F.lit(parts)).cast("int")
    doc_, data_, shard_ = (free_name(docs, n) for n in ("doc_of_row", "data_of_row", "shard_of_row"))
    sharded = docs.withColumn(doc_, number).withColumn(data_, data).withColumn(shard_, shard).select(
        *[c for c in docs.columns if c != text], doc_, data_, shard_)
    cut = sharded.groupBy(shard_).cogroup(told.filter("kind = 1").groupBy("shard")).applyInArrow(
        lambda a, b: _cut_contexts(a, b, parts, tagged), CONTEXTS)
    compared = cut.groupBy("bucket").applyInArrow(lambda t: _compare(t, length, parts), SPANS)
    found = told.filter("kind = 0").union(compared)

    crowded = told.filter("kind = 2")
    if not crowded.isEmpty():
        each = sharded.groupBy(shard_).cogroup(crowded.groupBy("shard")).applyInArrow(
            lambda a, b: _strings(a, b, length, tagged), "string binary, doc bigint, tag bigint, start bigint")
        each = stage(each)
        least = each.groupBy("string").agg(F.min("doc").alias("least"))
        later = each.join(least, "string").filter("doc > least").select("doc", "tag", "start")

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                doc, tag, start = (b.column(c).to_numpy() for c in ("doc", "tag", "start"))
                one = {"gram": np.zeros(len(doc), np.uint64), "doc": doc, "tag": tag, "start": start, "end": start + length}
                yield from _span_table(list(_spans(0, one, parts))).to_batches()

        found = found.union(later.mapInArrow(packed, SPANS))
    return strip(sharded, found, columns, make, tagged)


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per row: ``key, n_bytes, n_removed, n_spans, kept_sha256, spans`` (removed byte ranges).

    A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller
    key. Texts count as UTF-8 bytes, null as empty. Rows with a null key remove nothing and lose nothing; rows that
    repeat a key do not remove each other, but are compared with all others. Other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()

    def make(left: pa.Table, runs: list) -> pa.Table:
        spans = [[{"start": a, "end": b} for a, b in r] for _, r in runs]
        return pa.table({
            key: left.column(key), "n_bytes": pa.array([len(d) for d, _ in runs], pa.int64()),
            "n_removed": pa.array([sum(b - a for a, b in r) for _, r in runs], pa.int64()),
            "n_spans": pa.array([len(r) for _, r in runs], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(_remove(d, r)).hexdigest() for d, r in runs], pa.string()),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})

    columns = f"`{key}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"
    return _removal(docs.select(key, text), key, text, columns, make, length, gram)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with repeated strings cut out of the texts; documents of which nothing but white space is left go.

    Characters that lose some of their bytes go as a whole. Texts that lose nothing stay as they are, null ones too.
    """
    names = docs.columns
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def make(left: pa.Table, runs: list) -> pa.Table:
        kept, texts = [], []
        for i, (data, cut) in enumerate(runs):
            left_over = _remove(data, cut).decode("utf-8", "ignore")
            if not cut or left_over.strip():
                kept.append(i)
                texts.append(left_over)
        rows = left.take(pa.array(kept, pa.int64()))
        return pa.table({c: pa.array(texts, pa.string()) if c == text else rows.column(c) for c in names})

    null = docs.filter(F.col(text).isNull())
    return _removal(docs.filter(F.col(text).isNotNull()), key, text, columns, make, length, gram).unionByName(null)


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of all documents that repeat 50-byte strings of earlier ones."""
    return removed(read(spark, folder, "documents")).drop("spans")
