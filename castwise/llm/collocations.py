"""Phrase collocations with weighted acyclic automata: count transducers per shard, united by prefix range, composed for parts.

1. Words are counted. A bit map of fixed size over the hashes of frequent words ends runs at words that are
   certainly rare: no phrase with one is frequent, and a rare word that slips through is only counted in vain.
2. Every task turns a block of its texts into sorted windows of up to four words with counts, and these, range by
   range of their first words, into minimal acyclic transducers: states with equal arcs and weights are one.
3. The transducers of a range are united from the root on: equal paths become one, weights are added, and what
   cannot reach the least count is not followed further.
4. Frequent phrases ask for the counts of their parts; the requests of a range are composed with its transducer.

Phrases of very frequent words are dealt by more of their words, so no range holds more than a thousandth of a language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from castwise.llm.common import Stage, query, read, utf8

LEAST = 30  # occurrences of a candidate
LONGEST = 4  # words of a phrase
INSIDE = 80  # a candidate goes if a longer one around it has so many hundredths of its count
TOP = 2_000
UNIT = 2_000_000
UNKNOWN = "und"
BITS = 1 << 26  # of the map of frequent words; more words make it less selective, never wrong
PAGE = 32_768  # bits of one row of Spark's bitmap functions
HOT = 1_000  # a word is hot from this part of its language's words on: at most so many a language
BLOCK = 1_000_000  # words that one transducer build holds
OPEN_WORDS = 400_000  # counted words that a task holds
KNOWN_WORDS = 1_000_000  # hashed words that a task remembers
RANGE, RANGES = 1_000_000, 128  # words per range, least number of ranges
ASKED = 200_000  # requests composed with one copy of a range
SEED = 42
BREAK = b"."
_FOLD = bytes.maketrans(bytes(range(65, 91)) + b",;:!?\n\x0b\x0c\r", bytes(range(97, 123)) + BREAK * 9)
NO_STATE = 0
KINDS = "lang string, bucket int, labels binary, roots binary, starts2 binary, arcs2 binary, starts3 binary, arcs3 binary"
W = ["w1", "w2", "w3", "w4"]
PHRASES = "lang string, w1 bigint, w2 bigint, w3 bigint, w4 bigint, f bigint, complete boolean"


def tokens(data: bytes) -> list[bytes]:
    """The words of a text in order, with ``BREAK`` between pieces."""
    return data.translate(_FOLD).replace(BREAK, b" . ").split()


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, word, f`` of all words; the empty word has the number of all words of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang, counted in held.items():
                counted.pop(BREAK, None)
                counted[b""] = sum(counted.values())
                words = list(counted)
                for s in range(0, len(words), 65_536):
                    part = words[s: s + 65_536]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary()), pa.array([counted[w] for w in part], pa.int64())], ["lang", "word", "f"])
            held.clear()

        for batch in batches:
            for lang, data in zip(batch.column("lang").to_pylist(), batch.column("data")):
                held.setdefault(lang, Counter()).update(tokens(data.as_py()))
                if sum(map(len, held.values())) > OPEN_WORDS:
                    yield from told()
        yield from told()

    return docs.mapInArrow(run, "lang string, word binary, f bigint").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def word_hash(word):
    h = F.xxhash64(word)
    return F.when(h == 0, F.lit(1).cast("bigint")).otherwise(h)  # 0 stands for no word


def frequent_map(words: DataFrame) -> bytes:
    """``BITS`` bits in which those of all words' hashes are set. Built by Spark; the driver joins its pages."""
    at = F.pmod(F.xxhash64("word").bitwiseXOR(F.xxhash64("lang")), F.lit(BITS)) + 1
    pages = words.groupBy(F.bitmap_bucket_number(at).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = bytearray(BITS // 8)
    for page, bits in pages.collect():  # at most BITS / PAGE pages
        out[(page - 1) * PAGE // 8: page * PAGE // 8] = bits
    return bytes(out)


class Hashes(dict):
    """Word -> its hash, or 0 if the map says that it is rare."""

    def __init__(self, lang: str, bits: bytes):
        super().__init__({BREAK: 0})
        self.bits, self.seed = bits, xxhash.xxh64_intdigest(lang.encode(), SEED)

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
            self[BREAK] = 0
        h = xxhash.xxh64_intdigest(word, SEED)
        at = (h ^ self.seed) % (8 * len(self.bits))
        self[word] = found = (h or 1) if self.bits[at >> 3] >> (at & 7) & 1 else 0
        return found


def windows(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``labels, rows, counts``: all windows of two to four words, as sorted unique rows of label numbers (0: ended).

    A window starts at every word with a word behind it and is as long as its run allows.
    """
    stream = np.concatenate([stream, np.zeros(LONGEST, np.uint64)])
    labels, ids = np.unique(stream, return_inverse=True)
    ids = ids.astype(np.uint64)
    pairs, pair = np.unique(ids[:-1] << np.uint64(32) | ids[1:], return_inverse=True)
    pair = pair.astype(np.uint64)
    start = np.flatnonzero((ids[:-3] > 0) & (ids[1:-2] > 0))
    rest = np.where(ids[start + 2] > 0, pair[start + 2], 0).astype(np.uint64)  # pair 0 is (0, 0)
    quads, counts = np.unique(pair[start] << np.uint64(32) | rest, return_counts=True)
    low = np.uint64(0xFFFFFFFF)
    a, b = pairs[(quads >> np.uint64(32)).astype(np.int64)], pairs[(quads & low).astype(np.int64)]
    rows = np.stack([a >> np.uint64(32), a & low, b >> np.uint64(32), b & low], axis=1).astype(np.int64)
    return labels, rows, counts.astype(np.int64)


def depth_of_range(hot: np.ndarray) -> np.ndarray:
    """How many first words decide the range of a window, from ``[row, word]`` flags of hot words."""
    two = hot[:, 0] & hot[:, 1]
    return 2 + two + (two & hot[:, 2])


def ranges(labels: np.ndarray, depth: np.ndarray, buckets: int) -> np.ndarray:
    """Range number of ``[row, word]`` labels."""
    mixed = labels[:, 0] * np.uint64(0x9E3779B97F4A7C15) + labels[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = mixed + np.where(depth > 2, labels[:, 2], 0).astype(np.uint64) * np.uint64(0x165667B19E3779F9)
    mixed = mixed + np.where(depth > 3, labels[:, 3], 0).astype(np.uint64) * np.uint64(0x27D4EB2F165667C5)
    mixed ^= mixed >> np.uint64(29)
    mixed = mixed * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def freeze(owner: np.ndarray, arcs: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``state, starts, arcs``: one state per different set of arcs.

    ``owner`` is sorted and numbers the node of each arc ``[label, weight(, target)]``; nodes without arcs get ``NO_STATE``. State s has
    the arcs from ``starts[s]`` to ``starts[s + 1]``. States enter the register as their prefix is left.
    """
    counts = np.bincount(owner, minlength=owners)
    first = np.concatenate([[0], counts.cumsum()])
    state = np.zeros(owners, np.int64)
    one = np.flatnonzero(counts == 1)
    rows = arcs[first[one]].astype(np.uint64)
    key = rows[:, 0] << np.uint64(32) | rows[:, 1]
    if arcs.shape[1] > 2:
        key = np.unique(key, return_inverse=True)[1].astype(np.uint64) << np.uint64(32) | rows[:, 2]
    _, at, found = np.unique(key, return_index=True, return_inverse=True)
    state[one] = found + 1
    picked, sizes = [first[one[at]]], [np.ones(len(at), np.int64)]
    register: dict[bytes, int] = {}
    kept = []
    for node in np.flatnonzero(counts > 1).tolist():
        a, b = first[node], first[node + 1]
        arcs_of = arcs[a:b].tobytes()
        known = register.get(arcs_of)
        if known is None:
            known = register[arcs_of] = len(at) + 1 + len(kept)
            kept.append((a, b - a))
        state[node] = known
    if kept:
        a, n = np.array(kept).T
        picked.append(np.repeat(a - np.concatenate([[0], n.cumsum()[:-1]]), n) + np.arange(n.sum()))
        sizes.append(n)
    sizes = np.concatenate([[0], *sizes])  # state 0 has no arcs
    return state, np.concatenate([[0], sizes.cumsum()]), arcs[np.concatenate(picked)]


def build(rows: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """The minimal transducer of sorted unique windows ``[row, word]`` (label numbers) with their counts.

    ``roots``: first word, second word, weight, state. ``arcs2``: third word, weight, state; ``arcs3``: fourth word, weight.
    """
    change = np.ones((len(rows), 3), bool)
    if len(rows) > 1:
        different = rows[1:] != rows[:-1]
        change[1:, 1] = different[:, 0] | different[:, 1]
        change[1:, 2] = change[1:, 1] | different[:, 2]
    second, third = np.flatnonzero(change[:, 1]), np.flatnonzero(change[:, 2])
    of_third = change[:, 2].cumsum() - 1
    longest = np.flatnonzero(rows[:, 3] > 0)
    state3, starts3, arcs3 = freeze(of_third[longest], np.stack([rows[longest, 3], counts[longest]], axis=1).astype(np.uint32), len(third))
    weight3 = np.add.reduceat(counts, third)
    goes = rows[third, 2] > 0
    of_second = (change[:, 1].cumsum() - 1)[third]
    arcs = np.stack([rows[third, 2], weight3, state3], axis=1)[goes].astype(np.uint32)
    state2, starts2, arcs2 = freeze(of_second[goes], arcs, len(second))
    roots = np.stack([rows[second, 0], rows[second, 1], np.add.reduceat(counts, second), state2], axis=1).astype(np.uint32)
    return {"roots": roots, "starts2": starts2.astype(np.uint32), "arcs2": arcs2, "starts3": starts3.astype(np.uint32), "arcs3": arcs3}


def _planes(x: np.ndarray) -> bytes:
    """An array as byte planes: those of high bytes are mostly zero and cost nothing once compressed."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b""


def _rows(data: bytes, kind: type, width: int = 1) -> np.ndarray:
    size = np.dtype(kind).itemsize * width
    if not data:
        return np.zeros((0, width) if width > 1 else 0, kind)
    x = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind)
    return x if width > 1 else x.ravel()


def shard(lang: str, stream: np.ndarray, hot: np.ndarray, buckets: int) -> Iterator[dict]:
    """The transducers of a stream of hashes (0 between runs), one per range."""
    labels, rows, counts = windows(stream)
    if not len(rows):
        return
    is_hot = np.isin(labels, hot)
    bucket = ranges(labels[rows], depth_of_range(is_hot[rows]), buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) > 0, [True]]))
    for a, b in zip(cuts, cuts[1:]):
        mine = order[a:b]
        used, local = np.unique(np.concatenate([[0], rows[mine].ravel()]), return_inverse=True)
        made = build(local[1:].reshape(-1, LONGEST), counts[mine])
        yield {"lang": lang, "bucket": int(bucket[mine[0]]), "labels": _planes(labels[used]), **{k: _planes(v) for k, v in made.items()}}


def _expanded(state: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every entry of ``state`` its arcs: entry numbers and arc numbers."""
    n = starts[state + 1] - starts[state]
    entry = np.repeat(np.arange(len(state)), n)
    return entry, np.arange(len(entry)) - np.repeat(n.cumsum() - n, n) + starts[state][entry]


def _merged(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the keys, the first of each run of equal ones in it, and the run of every entry in it."""
    order = np.lexsort(keys[::-1])
    change = np.ones(len(order), bool)
    change[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, np.flatnonzero(change), change.cumsum() - 1


def united(pieces: list[dict], hot: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``words [n, 4], weights, complete`` of each length from the transducers of one range (``labels`` to ``arcs3`` as bytes).

    Prefixes below ``least`` are left out and not followed, unless other ranges hold windows with the prefix too (not complete).
    """
    labels, roots, starts2, arcs2, starts3, arcs3 = [], [], [], [], [], []
    at = {"label": 0, "s2": 0, "a2": 0, "s3": 0, "a3": 0}
    for p in pieces:
        own = _rows(p["labels"], np.uint64)
        r, a2, a3 = (_rows(p[k], np.uint32, width).astype(np.int64) for k, width in (("roots", 4), ("arcs2", 3), ("arcs3", 2)))
        s2, s3 = (_rows(p[k], np.uint32).astype(np.int64) for k in ("starts2", "starts3"))
        labels.append(own)
        roots.append(r + np.array([at["label"], at["label"], 0, at["s2"]]))
        arcs2.append(a2 + np.array([at["label"], 0, at["s3"]]))
        arcs3.append(a3 + np.array([at["label"], 0]))
        starts2.append(s2 + at["a2"])  # the end of a piece's last state is the start of an unused one
        starts3.append(s3 + at["a3"])
        for k, n in (("label", len(own)), ("s2", len(s2)), ("a2", len(a2)), ("s3", len(s3)), ("a3", len(a3))):
            at[k] += n
    label, roots, starts2, arcs2, starts3, arcs3 = (np.concatenate(a) for a in (labels, roots, starts2, arcs2, starts3, arcs3))

    order, first, run = _merged(label[roots[:, 0]], label[roots[:, 1]])
    roots = roots[order]
    weight = np.add.reduceat(roots[:, 2], first)
    words = np.zeros((len(first), LONGEST), np.uint64)
    words[:, 0], words[:, 1] = label[roots[first, 0]], label[roots[first, 1]]
    state, owner = roots[:, 3], run
    for depth, starts, arcs in ((2, starts2, arcs2), (3, starts3, arcs3), (4, None, None)):
        complete = ~np.isin(words[:, :depth], hot).all(axis=1) if depth < LONGEST else np.ones(len(words), bool)
        keep = ~complete | (weight >= least)
        yield words[keep], weight[keep], complete[keep]
        if starts is None or not keep.any():
            return
        follow = keep[owner]
        state, owner = state[follow], owner[follow]
        entry, arc = _expanded(state, starts)
        if not len(arc):
            return
        above, found = owner[entry], label[arcs[arc, 0]]
        order, first, run = _merged(above, found)
        arc = arc[order]
        weight = np.add.reduceat(arcs[arc, 1], first)
        longer = words[above[order][first]].copy()
        longer[:, depth] = label[arcs[arc[first], 0]]
        words, owner = longer, run
        state = arcs[arc, 2] if arcs.shape[1] > 2 else np.zeros(len(arc), np.int64)


def look_up(phrases: np.ndarray, weights: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Weights of the asked paths in the transducer of ``phrases`` (both ``[n, 4]``, 0: ended), walked word by word; 0: no such path."""
    labels = np.unique(np.concatenate([phrases.ravel(), np.zeros(1, np.uint64)]))
    own = np.searchsorted(labels, phrases).astype(np.int64)
    place = np.minimum(np.searchsorted(labels, asked), len(labels) - 1)
    known = (labels[place] == asked).all(axis=1)
    state, walker = np.zeros(len(own), np.int64), np.zeros(len(asked), np.int64)
    for d in range(LONGEST):
        arcs, state = np.unique(state << 32 | own[:, d], return_inverse=True)
        key = walker << 32 | place[:, d]
        walker = np.minimum(np.searchsorted(arcs, key), max(0, len(arcs) - 1))
        known &= arcs[walker] == key if len(arcs) else False
    weight = np.zeros(max(1, len(arcs)), np.int64)
    weight[state] = weights  # every phrase is told once
    return np.where(known, weight[walker], 0)


def frequent_phrases(docs: DataFrame, words: DataFrame, stage: Stage, least: int) -> DataFrame:
    """``lang, w1..w4, f`` of all phrases of two to four words that occur ``least`` times."""
    spark = docs.sparkSession
    real, totals = words.filter(F.length("word") > 0), words.filter(F.length("word") == 0).select("lang", F.col("f").alias("n"))
    bits = spark.sparkContext.broadcast(frequent_map(real))
    hottest = real.join(F.broadcast(totals), "lang").filter(F.col("f") * HOT > F.col("n")).select("lang", word_hash("word").alias("h"))
    hot: dict[str, list[int]] = {}
    for lang, h in hottest.collect():  # at most HOT words a language
        hot.setdefault(lang, []).append(h)
    hot = {lang: np.array(sorted(h), np.int64).view(np.uint64) for lang, h in hot.items()}
    none = np.zeros(0, np.uint64)
    total = totals.agg(F.sum("n")).first()[0] or 0
    buckets = max(RANGES, -(-total // RANGE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Hashes] = {}
        held: dict[str, list[np.ndarray]] = {}
        sizes: Counter = Counter()
        names = ["lang", "bucket", "labels", "roots", "starts2", "arcs2", "starts3", "arcs3"]

        def told(lang: str) -> Iterator[pa.RecordBatch]:
            sizes.pop(lang)
            rows = list(shard(lang, np.concatenate(held.pop(lang)), hot.get(lang, none), buckets))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], {"lang": pa.string(), "bucket": pa.int32()}.get(n, pa.binary()))
                                                  for n in names], names)

        for batch in batches:
            for lang, data in zip(batch.column("lang").to_pylist(), batch.column("data")):
                if lang not in known:
                    if len(known) >= 16:
                        known.clear()
                    known[lang] = Hashes(lang, bits.value)
                found = np.fromiter(map(known[lang].__getitem__, tokens(data.as_py())), np.uint64)
                # of runs of rare words and breaks one break is kept
                found = found[(found > 0) | np.concatenate([[False], found[:-1] > 0])] if len(found) else found
                held.setdefault(lang, []).append(np.concatenate([found, np.zeros(1, np.uint64)]))
                sizes[lang] += len(found) + 1
                if sizes[lang] >= BLOCK:
                    yield from told(lang)
                elif sum(sizes.values()) >= 2 * BLOCK:
                    yield from told(sizes.most_common(1)[0][0])
        for lang in list(held):
            yield from told(lang)

    def union(table: pa.Table) -> pa.Table:
        lang = table.column("lang")[0].as_py()
        out = [pa.table({"lang": pa.array([lang] * len(f), pa.string()), **{w: np.ascontiguousarray(words[:, i]).view(np.int64) for i, w in enumerate(W)},
                         "f": f, "complete": complete})
               for words, f, complete in united(table.drop_columns(["lang", "bucket"]).to_pylist(), hot.get(lang, none), least)]
        return pa.concat_tables(out)

    pieces = docs.mapInArrow(run, KINDS)
    found = stage(pieces.groupBy("lang", "bucket").applyInArrow(union, PHRASES))
    shared = found.filter(~F.col("complete")).groupBy("lang", *W).agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return found.filter("complete").select("lang", *W, "f").union(shared)


def part_counts(asked: DataFrame, phrases: DataFrame) -> DataFrame:
    """``asked`` with the count ``part_f`` of its part ``lang, p1..p4``, by composing requests and transducers range by range.

    Requests of one range are dealt to as many copies of it as keep a group at about ``ASKED`` requests.
    """
    p = ["p1", "p2", "p3", "p4"]
    buckets = max(RANGES, -(-phrases.count() // ASKED))
    asked = asked.withColumn("bucket", F.pmod(F.xxhash64("lang", "p1", "p2"), F.lit(buckets)).cast("int"))
    loads = asked.groupBy("bucket").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("copies"))
    dealt = F.pmod(F.xxhash64(*W, *p), F.col("copies")).cast("int")
    left = asked.join(F.broadcast(loads), "bucket").withColumn("copy", dealt).drop("copies")
    right = phrases.withColumn("bucket", F.pmod(F.xxhash64("lang", "w1", "w2"), F.lit(buckets)).cast("int")).join(F.broadcast(loads), "bucket").withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    # both sides come from the phrases: columns of their own keep them apart
    right = right.select(*[F.col(c).alias(f"{c}_") for c in ("lang", *W, "f", "bucket", "copy")])
    names = [c for c in asked.columns if c not in ("bucket", *p)]
    schema = ", ".join(f"{c} {asked.schema[c].dataType.simpleString()}" for c in names) + ", part_f bigint"

    def matrix(table: pa.Table, columns: list[str]) -> np.ndarray:
        return np.stack([table.column(c).to_numpy() for c in columns], axis=1).astype(np.int64).view(np.uint64).reshape(-1, LONGEST)

    def compose(requests: pa.Table, told: pa.Table) -> pa.Table:
        found = np.zeros(requests.num_rows, np.int64)
        mine = np.array(requests.column("lang").to_pylist(), object)
        theirs = np.array(told.column("lang_").to_pylist(), object)
        for lang in set(mine.tolist()):
            a, b = np.flatnonzero(mine == lang), np.flatnonzero(theirs == lang)
            if len(b):
                found[a] = look_up(matrix(told.take(b), [f"{w}_" for w in W]), told.column("f_").to_numpy()[b], matrix(requests.take(a), p))
        return requests.select(names).append_column("part_f", pa.array(found))

    return left.groupBy("bucket", "copy").cogroup(right.groupBy("bucket_", "copy_")).applyInArrow(compose, schema)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of every language by their weakest cut.

    Null texts are empty, a null language is ``und``; repeated rows count as often as they occur. Languages without a candidate
    have no row. Words are told apart by 64 bits of hash.
    """
    stage = Stage(docs.sparkSession, "collocations")
    rows = docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), utf8(F.col(text)).alias("data"))
    words = stage(word_counts(rows).filter((F.col("f") >= least) | (F.length("word") == 0)))
    real = words.filter(F.length("word") > 0).withColumn("h", word_hash("word"))
    phrases = stage(frequent_phrases(rows, words, stage, least))

    zero = F.lit(0).cast("bigint")
    w = [F.col(c) for c in W]
    length = F.when(w[2] == 0, 2).when(w[3] == 0, 3).otherwise(4)

    def piece(columns):
        return [*columns, *[zero] * (LONGEST - len(columns))]

    def cuts(n: int):
        return [F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), *[c.alias(f"p{i + 1}") for i, c in enumerate(piece(part))])
                for k in range(1, n) for side, part in ((0, w[:k]), (1, w[k:n]))]

    def inner(n: int):
        return [F.struct(*[c.alias(f"p{i + 1}") for i, c in enumerate(piece(w[s: s + m]))]) for m in range(2, n) for s in range(n - m + 1)]

    asked = phrases.withColumn("cut", F.explode(F.when(length == 2, F.array(*cuts(2))).when(length == 3, F.array(*cuts(3))).otherwise(F.array(*cuts(4)))))
    asked = asked.select("lang", *W, F.col("f").alias("a"), "cut.*")
    parts = phrases.union(real.select("lang", F.col("h"), zero, zero, zero, "f"))
    answers = part_counts(asked, parts).select("lang", *W, "a", "k", "side", "part_f", F.lit(None).cast("bigint").alias("longer"))
    # every phrase inside a longer one is a candidate itself: it occurs as often at least
    held = phrases.filter(w[2] != 0).withColumn("p", F.explode(F.when(length == 3, F.array(*inner(3))).otherwise(F.array(*inner(4)))))
    marks = held.groupBy("lang", "p").agg(F.max("f").alias("longer")).select(
        "lang", "p.*", *[F.lit(None).cast(t) for t in ("bigint", "int", "int", "bigint")], "longer")
    one = {f"{'lr'[side]}{k}": F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("part_f"))) for k in (1, 2, 3) for side in (0, 1)}
    told = answers.union(marks).groupBy("lang", *W).agg(
        F.max("a").alias("a"), F.max("longer").alias("longer"), *[c.alias(n) for n, c in one.items()])
    whole = "decimal(38,0)"
    told = told.filter(F.col("longer").isNull() | (F.col("longer").cast(whole) * 100 < F.col("a").cast(whole) * inside))
    weakest = F.array_min(F.array(*[F.when(F.col(f"l{k}").isNotNull(), F.struct(
        F.expr(f"cast(cast(a as decimal(20,0)) * {UNIT} as {whole}) div cast(l{k} + r{k} as {whole})").alias("score"), F.lit(k).alias("k"),
        F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in (1, 2, 3)]))
    scored = told.withColumn("cut", weakest).select("lang", *W, "a", "cut.l", "cut.r", "cut.score")
    # ties are kept until their words are known
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    near = stage(scored.withColumn("place", F.rank().over(best)).filter(F.col("place") <= top).drop("place"))
    spelled = near.select("*", F.posexplode(F.array(*w)).alias("at", "h")).filter("h <> 0").join(real.select("lang", "h", "word"), ["lang", "h"])
    spelled = spelled.groupBy("lang", *W, "a", "l", "r", "score").agg(F.array_sort(F.collect_list(F.struct("at", F.col("word").cast("string").alias("word")))).alias("ws"))
    named = spelled.withColumn("phrase", F.array_join("ws.word", " "))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    totals = words.filter(F.length("word") == 0).select("lang", F.col("f").alias("n"))
    ranked = named.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
with t as (select coalesce(lang, 'und') as lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x from documents),
p as (select lang, unnest(string_split_regex(x, '[.,;:!?\x0A-\x0D]')) as piece from t),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
i as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from w),
g as (select lang, k, array_to_string(ws[i:i + k - 1], ' ') as phrase from i, (values (1), (2), (3), (4)) as k(k) where i + k - 1 <= len(ws)),
f as (select lang, k, phrase, count(*) as f from g group by all),
n as (select lang, sum(f)::bigint as n from f where k = 1 group by lang),
c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as ws from f where k > 1 and f >= 30),
cut as (select lang, phrase, a, k, unnest(range(1, k)) as j, ws from c),
s as (select cut.lang, cut.phrase, cut.a, cut.j, x.f as l, y.f as r, (2000000::hugeint * cut.a // (x.f + y.f))::bigint as score
      from cut join f x on x.lang = cut.lang and x.phrase = array_to_string(ws[1:j], ' ') and x.k = j
      join f y on y.lang = cut.lang and y.phrase = array_to_string(ws[j + 1:], ' ') and y.k = cut.k - j),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, j) = 1),
o as (select lang, a as longer, unnest([array_to_string(ws[q[1]:q[1] + q[2] - 1], ' ') for q in
             [[1, 2], [2, 2], [3, 2], [1, 3], [2, 3]] if q[2] < k and q[1] + q[2] - 1 <= k]) as phrase from c where k > 2),
m as (select lang, phrase, max(longer) as longer from o group by all),
kept as (select b.* from b left join m using (lang, phrase) where m.longer is null or 100 * m.longer < 80 * b.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n, score from ranked join n using (lang) where rank <= 2000
"""


@query("op13_collocations", SQL)
def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The strongest collocations of every language of all documents."""
    return collocations(read(spark, folder, "documents"))
