"""Brown class bigrams: exchange clustering of words, class transitions, smoothed document scores."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castwise.llm.common import Stage, fold, query, read, utf8

FOLDS, HELD_OUT = 10, 0
END = b"\n"  # the end token: no word contains white space
ADD = 0.1  # added to every count, of the base model and of emissions
ADD_CLASS = 0.5
WEIGHT = 0.95  # of the class model against the base model
KNOWN = 1 << 17  # most frequent words that every task holds, at most; all others are looked up by a join
STEPS_PER_OCTAVE = 16  # of the histogram of word counts that the most frequent words are cut off with
KNOWN_BYTES = 64  # longer words are never among them, so the table has a fixed size at most
EXCHANGED = 1 << 13  # most frequent words that exchange classes; the other known ones take the class of largest gain then
CLASSES = 64
PASSES = 6
FLUSH = 200_000  # different words a task counts before it passes them on
BLOCK = 64  # words whose context counts travel together

# Class 0 holds the end token, class 1 all words that tasks do not know, seen or not.
END_CLASS, OTHER_CLASS, FIRST_CLASS = 0, 1, 2


def tokens(data: bytes) -> list[bytes]:
    return [*data.lower().split(), END]


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, c`` of every token of the ``data`` column. Tasks count first, in tables of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for data in batch.column("data"):
                counts.update(tokens(data.as_py()))
                if len(counts) > FLUSH:
                    yield flush()
        if counts:
            yield flush()

    return texts.select("data").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("c"))


def _ids(texts: DataFrame, ids: dict[bytes, int], other: int) -> DataFrame:
    """Id sequences of batches of texts, one after another, each closed by the end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = ids.get
        for batch in batches:
            seqs = [np.fromiter((get(w, other) for w in tokens(x.as_py())), np.uint32).tobytes() for x in batch.column("data")]
            yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.binary())], ["ids"])

    return texts.select("data").mapInArrow(run, "ids binary")


def _contexts(sequences: DataFrame, word_class: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts ``[word, class]`` of the classes before and behind every word of the core; the last entry stands for all others.

    Each task sums its texts in two tables of fixed size and passes them on in blocks of words;
    the blocks are added up as they arrive. What reaches the driver depends on the number of
    clustered words and classes only.
    """
    words = len(word_class)
    blocks = -(-words // BLOCK)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = np.zeros(words * classes, np.int64), np.zeros(words * classes, np.int64)
        for batch in batches:
            joined = b"".join(x.as_py() for x in batch.column("ids"))
            seq = np.minimum(np.concatenate([[0], np.frombuffer(joined, np.uint32)]).astype(np.int64), words - 1)
            kind = word_class[seq]
            left += np.bincount(seq[1:] * classes + kind[:-1], minlength=words * classes)
            right += np.bincount(seq[:-1] * classes + kind[1:], minlength=words * classes)
        both = np.stack([left.reshape(words, classes), right.reshape(words, classes)], axis=1)
        parts = [both[i * BLOCK: (i + 1) * BLOCK] for i in range(blocks)]
        full = [i for i, x in enumerate(parts) if x.any()]
        if full:
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), pa.array([parts[i].tobytes() for i in full], pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts")):
                seen = np.frombuffer(counts.as_py(), np.int64)
                total[block] = total[block] + seen if block in total else seen
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())],
                ["block", "counts"])

    schema = "block int, counts binary"
    rows = sequences.mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).collect()
    out = np.zeros((blocks * BLOCK, 2, classes), np.float64)
    for r in rows:
        got = np.frombuffer(r["counts"], np.int64).reshape(-1, 2, classes)
        out[r["block"] * BLOCK: r["block"] * BLOCK + len(got)] = got
    return out[:words, 0], out[:words, 1]


def _entropy(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(word_class: np.ndarray, left: np.ndarray, right: np.ndarray) -> int:
    """Moves words, most frequent first, to the class that gains most mutual information; how many moved.

    ``left`` and ``right`` were counted with the classes at the start of the pass; the class
    transitions are kept up to date move by move. Words of the fixed classes stay.
    """
    k = left.shape[1]
    table = np.zeros((k, k))
    np.add.at(table, word_class, right)
    moved = 0
    for w in range(len(word_class)):
        a = word_class[w]
        if a < FIRST_CLASS:
            continue
        r, l = right[w], left[w]
        table[a] -= r
        table[:, a] -= l
        np.maximum(table, 0, out=table)
        rows = (_entropy(table + r) - _entropy(table)).sum(axis=1)
        cols = (_entropy(table + l[:, None]) - _entropy(table)).sum(axis=0)
        out_sum, in_sum = table.sum(axis=1), table.sum(axis=0)
        gain = rows + cols - _entropy(out_sum + r.sum()) + _entropy(out_sum) - _entropy(in_sum + l.sum()) + _entropy(in_sum)
        gain[:FIRST_CLASS] = -np.inf
        b = int(gain.argmax())
        b = b if gain[b] > gain[a] + 1e-9 else a
        table[b] += r
        table[:, b] += l
        if b != a:
            word_class[w] = b
            moved += 1
    return moved


def _assigned(sequences: DataFrame, core: np.ndarray, table: np.ndarray, known: int) -> np.ndarray:
    """Classes of all ``known`` words and, last, of the others: those outside the core take the class that gains most
    mutual information with their own neighbours' classes.

    Tasks pass on how often a word stands beside a class, batches of texts added up before; so a word in every
    text is a few rows a task. The driver receives one class a word, at most ``KNOWN``.
    """
    kinds, others = len(table), len(core) - 1
    kind_of = np.concatenate([core[:others], np.full(known + 1 - others, OTHER_CLASS)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids in batch.column("ids"):
                seq = np.concatenate([[0], np.frombuffer(ids.as_py(), np.uint32)]).astype(np.int64)
                at = np.flatnonzero((seq >= others) & (seq < known))  # the end token stands before and behind every text
                word, kind = seq[at] * (2 * kinds), kind_of[seq]
                key, n = np.unique(np.concatenate([word + kind[at - 1], word + kinds + kind[at + 1]]), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((key // (2 * kinds)).astype(np.int32)), pa.array((key % (2 * kinds)).astype(np.int32)), pa.array(n)], ["word", "slot", "n"])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, out_sum, in_sum = _entropy(table), table.sum(axis=1), table.sum(axis=0)
        for batch in batches:
            best = []
            for beside in batch.column("beside").to_pylist():
                both = np.zeros(2 * kinds)
                both[[x["slot"] for x in beside]] = [x["n"] for x in beside]
                l, r = both[:kinds], both[kinds:]
                gain = (_entropy(table + r) - before).sum(axis=1) + (_entropy(table + l[:, None]) - before).sum(axis=0)
                gain += _entropy(out_sum) - _entropy(out_sum + r.sum()) + _entropy(in_sum) - _entropy(in_sum + l.sum())
                gain[:FIRST_CLASS] = -np.inf
                best.append(int(gain.argmax()))
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(best, pa.int32())], ["word", "kind"])

    if others >= known:
        return kind_of
    met = sequences.mapInArrow(count, "word int, slot int, n bigint").groupBy("word", "slot").agg(F.sum("n").alias("n"))
    beside = met.groupBy("word").agg(F.collect_list(F.struct("slot", "n")).alias("beside"))  # two entries a class, at most
    for word, kind in beside.mapInArrow(assign, "word int, kind int").collect():
        kind_of[word] = kind
    return kind_of


def _transitions(sequences: DataFrame, kind_of: np.ndarray, kinds: int) -> np.ndarray:
    """How often each class follows each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(kinds * kinds, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                kind = kind_of[np.concatenate([[0], np.frombuffer(ids.as_py(), np.uint32)]).astype(np.int64)]
                table += np.bincount(kind[:-1] * kinds + kind[1:], minlength=kinds * kinds)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at])], ["at", "n"])

    out = np.zeros(kinds * kinds)
    for at, n in sequences.mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n")).collect():
        out[at] = n
    return out.reshape(kinds, kinds)


@dataclass
class Model:
    """What a task needs to score: words it knows, their counts and classes, and the tables of both models."""

    ids: dict[bytes, int]
    counts: np.ndarray  # [known word], and 0 for "not known here"
    word_class: np.ndarray  # [known word + 1]
    transition: np.ndarray  # [class, class]
    emission: np.ndarray  # [known word + 1]; of words with a class and the end
    other_space: float  # total of (c + ADD) over the words without a class and the unseen one
    base_space: float  # total of (c + ADD) over all words and the unseen one
    tokens: int

    def score(self, data: bytes) -> tuple[int, int, float, float, Counter]:
        """Tokens, known ones, log10 base score and model score, and the words whose count must be looked up.

        Such a word adds log10(c + ADD) to both scores for each time it occurs, and counts as known if c > 0.
        """
        words = tokens(data)
        get, unknown = self.ids.get, len(self.ids)
        at = np.fromiter((get(w, unknown) for w in words), np.int64, len(words))
        kind = self.word_class[at]
        before = np.concatenate([[END_CLASS], kind[:-1]])
        found = at < unknown
        plus = np.where(found, self.counts[at] + ADD, 1.0)
        base = np.log10(plus).sum() - len(at) * math.log10(self.base_space)
        go = self.transition[before, kind]
        clustered = kind != OTHER_CLASS
        inside = np.where(clustered, self.emission[at], plus / self.other_space)
        score = np.log10(WEIGHT * go * inside + (1 - WEIGHT) * plus / self.base_space).sum()
        rare = Counter(w for w, f in zip(words, found.tolist()) if not f)
        return len(words), int(found.sum()), float(base), float(score), rare


def train(texts: DataFrame, stage: Stage, classes: int = CLASSES, exchanged: int = EXCHANGED, known: int = KNOWN,
          passes: int = PASSES) -> tuple[Model, DataFrame]:
    """The model of the ``data`` column and the staged ``word, c`` table of all its words.

    All words of all texts are counted. The most frequent ones exchange classes in passes over the staged id sequences, all other
    known words then take the class of largest gain, and the transitions are counted with all of them.
    """
    counts = stage(word_counts(texts))
    total, different = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    end = F.col("word") == F.lit(END)
    ends = counts.filter(end).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    # the most frequent words are cut off by a histogram of counts (a few hundred rows, whatever the corpus), not by a global sort
    step = F.floor(F.log2("c") * STEPS_PER_OCTAVE)
    able = counts.filter((F.length("word") <= KNOWN_BYTES) & ~end)
    steps = sorted(((r["step"], r["n"]) for r in able.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    room, lowest = known, None
    for at, n in steps:
        if n > room:
            break
        room, lowest = room - n, at
    frequent = [] if lowest is None else able.filter(step >= lowest).collect()  # at most ``known`` rows
    frequent = sorted(((bytes(r["word"]), r["c"]) for r in frequent), key=lambda x: (-x[1], x[0]))
    words = [END, *(w for w, _ in frequent)]
    count_of = {END: ends, **dict(frequent)}
    ids = {w: i for i, w in enumerate(words)}
    number = np.array([count_of.get(w, 0) for w in words] + [0], np.float64)

    clustered = min(exchanged, len(words))
    kinds = classes + FIRST_CLASS
    word_class = np.array([END_CLASS] + [FIRST_CLASS + i % classes for i in range(clustered - 1)] + [OTHER_CLASS])
    sequences = stage(_ids(texts, ids, len(words)))
    left, right = _contexts(sequences, word_class, kinds)
    for _ in range(passes):
        moved = exchange(word_class, left, right)
        left, right = _contexts(sequences, word_class, kinds)
        if moved < clustered // 100:
            break
    table = np.zeros((kinds, kinds))
    np.add.at(table, word_class, right)
    full = _assigned(sequences, word_class, table, len(words))
    table = _transitions(sequences, full, kinds)
    stage.drop(sequences)

    used = np.isin(np.arange(kinds), full)  # an empty class is never entered
    transition = (table + ADD_CLASS * used) / (table.sum(axis=1, keepdims=True) + ADD_CLASS * used.sum())
    mine = number[:-1] + ADD
    emission = np.zeros(len(words) + 1)
    emission[:-1] = mine / np.bincount(full[:-1], mine, kinds)[full[:-1]]
    known_types = int((number > 0).sum())
    other_space = total - number.sum() + ADD * (different - known_types + 1)
    base_space = total + ADD * (different + 1)
    return Model(ids, number, full, transition, emission, other_space, base_space, total), counts


def scores(docs: DataFrame, model: Model, counts: DataFrame, stage: Stage, carry: tuple[str, ...]) -> DataFrame:
    """``carry`` columns of ``docs`` (with ``data``), ``n_tokens, n_known, base_score, score`` of every row.

    A text is scored where it is read, but for words that are too rare to be held by every task: these are
    joined with the counts by word and their sums brought back to the row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare_type = pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())]))
        for batch in batches:
            n, known, base, score, rare = [], [], [], [], []
            for data in batch.column("data"):
                a, b, c, d, e = model.score(data.as_py())
                n.append(a)
                known.append(b)
                base.append(c)
                score.append(d)
                rare.append([{"word": w, "times": t} for w, t in e.items()])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", *carry)), pa.array(n, pa.int64()), pa.array(known, pa.int64()),
                 pa.array(base), pa.array(score), pa.array(rare, rare_type)],
                ["row", *carry, "n_tokens", "n_known", "base_score", "score", "rare"])

    kept = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    schema = f"row bigint, {kept}, n_tokens bigint, n_known bigint, base_score double, score double, rare array<struct<word:binary,times:bigint>>"
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), *carry, "data")
    local = stage(numbered.mapInArrow(run, schema))  # written once, so row numbers stay what they are
    rare = local.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times")
    found = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(ADD))).alias("more"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"))
    none = F.lit(0)
    return local.drop("rare").join(found, "row", "left").select(
        *carry, "n_tokens", (F.col("n_known") + F.coalesce("more_known", none)).alias("n_known"),
        (F.col("base_score") + F.coalesce("more", none)).alias("base_score"),
        (F.col("score") + F.coalesce("more", none)).alias("score"))


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Scores of all rows by a model of the rows outside the held-out fold.

    Returns ``key, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity`` (of the
    model, per token). A null text is an empty one: its only token is the end. Rows with a null key are
    learned from. Repeated rows are learned from and scored each; an empty table gives no rows.
    """
    stage = Stage(docs.sparkSession, "classlm")
    held = F.coalesce(fold(F.col(key), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    rows = docs.select(F.col(key).alias("key"), held, utf8(F.col(text)).alias("data"))
    model, counts = train(rows.filter(~F.col("held_out")), stage, **options)
    out = scores(rows, model, counts, stage, ("key", "held_out"))
    return out.select(
        F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


@query("op6_class_lm")
def op6_class_lm(spark: SparkSession, folder: str) -> DataFrame:
    """Class bigram scores of all documents."""
    return score_documents(read(spark, folder, "documents"))
