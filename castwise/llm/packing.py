"""Packing of token sequences: shortest-pack-first over the length histogram, patterns joined back by rank."""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castwise.llm.common import Stage, query, read, utf8
from castwise.operators.sequences import positions

SIZE = 2048
END_ID = 1
CACHED_WORDS = 1 << 17  # words, and pieces, that a worker remembers twice over: the newest, and those before
SPECIAL = b"<|"  # how the texts of special tokens begin
PRINTABLE = bytes(range(33, 127))
SPACES = b" \t\n\r\x0b\x0c"
# Fixed: how the tokenizer cuts lowered text.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
ASCII_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
LATIN = re.compile("[!-~\u00a1-\u012f\u0131-\u024f]+")  # words of these have one form, and their lower case is told letter by letter
LATIN_TEXT = re.compile("[ \t-\r!-~\u00a1-\u012f\u0131-\u024f]+")  # such words and the spaces between them


def _latin_piece() -> re.Pattern:
    """``PIECE`` for lowered texts of ``LATIN_TEXT``, by lists of their letters and numbers."""
    lowered = {c for i in range(0x250) if LATIN.fullmatch(chr(i)) for c in chr(i).lower()}
    letters, numbers = (re.escape("".join(sorted(c for c in lowered if regex.match(kind, c)))) for kind in (r"\p{L}", r"\p{N}"))
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+")


LATIN_PIECE = _latin_piece()

# How byte-level tokenizers write bytes: printable ones as themselves, the others from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}

_ENCODERS: dict[str, Encoder] = {}


class _Newest(dict):
    """Results of ``make``, remembered for the newest keys and for those before."""

    def __init__(self, make: Callable[[Any], bytes]):
        self.make, self.older = make, {}

    def __missing__(self, key: Any) -> bytes:
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= CACHED_WORDS:
            self.older = dict(self)
            self.clear()
        self[key] = got
        return got


class Encoder:
    """Ids of whole texts by a public tokenizer that lowers its input and splits it at white space.

    Such a tokenizer never merges across the borders of the pieces it cuts a text into, so a piece goes through
    the merges once and is remembered; the ids of a text are those of its pieces in turn. Texts of printable ASCII
    and of Latin letters are lowered and cut here, whole. Of others every word between ASCII spaces is encoded
    once and remembered; what is not Latin is cut by the tokenizer's own steps, and words that may hold
    the text of a special token are encoded as they are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # workers are processes already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.words, self.pieces, self.cut_pieces = _Newest(self._word), _Newest(self._piece), _Newest(self._merged)

    def _merged(self, piece: str) -> bytes:
        """The ids of a piece whose bytes are written the tokenizer's way."""
        return b"".join([self.id_bytes[t.id] for t in self.tokenizer.model.tokenize(piece)])

    def _piece(self, piece: str) -> bytes:
        return self._merged(piece if piece.isascii() else piece.encode().decode("latin-1").translate(BYTE_CHARS))

    def _word(self, word: bytes) -> bytes:
        if SPECIAL in word:
            ids = self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
            return b"".join([self.id_bytes[i] for i in ids])
        got = self._latin(word)
        if got is None:
            text = self.tokenizer.normalizer.normalize_str(word.decode("utf-8", "replace"))
            got = b"".join([self.cut_pieces[p] for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)])
        return got

    def _latin(self, data: bytes) -> bytes | None:
        """The ids of a text without special tokens, if it is Latin."""
        if not data.translate(None, PRINTABLE + SPACES):
            cut = ASCII_PIECE.findall(data.decode("ascii").lower())
        elif LATIN_TEXT.fullmatch(text := data.decode("utf-8", "replace")):
            cut = LATIN_PIECE.findall(text.lower())
        else:
            return None
        return b"".join(map(self.pieces.__getitem__, cut))

    def ids(self, data: bytes) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        got = None if SPECIAL in data else self._latin(data)
        return b"".join(map(self.words.__getitem__, data.split())) if got is None else got


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer_path: str, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's ids, closed by ``END_ID`` and cut every ``size`` ids.

    Returns ``key, start, length, ids_crc32, doc_tokens``. A null or empty text has the end id only.
    """
    end = np.array([END_ID], "<u4").tobytes()
    bare = docs.select(F.col(key).alias("key"), utf8(F.col(text)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = encoder(tokenizer_path)
        for batch in batches:
            row, start, length, crc, tokens = [], [], [], [], []
            for i, data in enumerate(batch.column("text")):
                ids = split.ids(data.as_py()) + end
                n = len(ids) // 4
                for at in range(0, n, size):
                    to = min(n, at + size)
                    row.append(i)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(ids[4 * at: 4 * to]))
                    tokens.append(n)
            if row:
                numbers = [pa.array(x, pa.int64()) for x in (start, length, crc, tokens)]
                keys = batch.column("key").take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, *numbers], ["key", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    return bare.mapInArrow(run, schema).withColumnRenamed("key", key)


@dataclass
class Pattern:
    """``packs`` packs that all hold the same lengths: runs of (length, times), longest first."""

    packs: int
    runs: tuple[tuple[int, int], ...]

    def used(self) -> int:
        return sum(length * times for length, times in self.runs)


def shortest_pack_first(histogram: Mapping[int, int], size: int = SIZE) -> list[Pattern]:
    """Packing patterns for ``{length: pieces}``, lengths placed longest first.

    A length goes to the packs with the most room left; a pattern with more packs than pieces left
    is split in two. Without a pack that has room, new packs take as many of the length as fit.
    Works on counts only: its cost follows the number of different lengths, not of documents.
    """
    open_: dict[int, list[Pattern]] = {}
    rooms: list[int] = []  # a heap of negated rooms, with leftovers of emptied ones
    done: list[Pattern] = []

    def put(pattern: Pattern, room: int) -> None:
        if room == 0:
            done.append(pattern)
        else:
            if not open_.setdefault(room, []):
                heapq.heappush(rooms, -room)
            open_[room].append(pattern)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= size:
            raise ValueError(f"length {length} is not within 1 and {size}")
        while left:
            while rooms and not open_.get(-rooms[0]):
                heapq.heappop(rooms)
            room = -rooms[0] if rooms else 0
            if room < length:
                each = size // length
                full, rest = divmod(left, each)
                if full:
                    put(Pattern(full, ((length, each),)), size - each * length)
                if rest:
                    put(Pattern(1, ((length, rest),)), size - rest * length)
                break
            pattern = open_[room].pop()
            placed = min(left, pattern.packs)
            if placed < pattern.packs:
                open_[room].append(Pattern(pattern.packs - placed, pattern.runs))
            *head, last = pattern.runs
            runs = (*head, (length, last[1] + 1)) if last[0] == length else (*pattern.runs, (length, 1))
            put(Pattern(placed, runs), room - length)
            left -= placed
    return [*done, *(p for same in open_.values() for p in same)]


def slots(patterns: list[Pattern]) -> pd.DataFrame:
    """Where the pieces of every length go, by their rank among pieces of that length.

    A row stands for ``packs * times`` ranks from ``first`` on: the ranks run through the packs
    ``times`` times, each time one length further into the pack.
    """
    rows, taken, base = [], {}, 0
    for p in patterns:
        offset = 0
        for length, times in p.runs:
            first = taken.get(length, 0)
            rows.append((length, first, p.packs, base, offset))
            taken[length] = first + p.packs * times
            offset += length * times
        base += p.packs
    return pd.DataFrame(rows, columns=["length", "first", "packs", "base", "offset"]).sort_values(["length", "first"])


def pack(cut: DataFrame, size: int = SIZE, order: tuple[str, ...] = ("doc_id", "start", "ids_crc32")) -> DataFrame:
    """``cut`` with ``sequence_id`` and ``offset`` of every piece; needs a column ``length``.

    The histogram has at most ``size`` rows, and the patterns made of it a few per length: both are
    small whatever the corpus. Ranks inside one length come from range partitions and their sizes
    (``positions``), so a length that a third of the pieces have is spread like any other.
    """
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = slots(shortest_pack_first(histogram, size))
    start = (plan["length"].to_numpy(np.int64) << 48) + plan["first"].to_numpy(np.int64)
    first, packs, base, offset = (plan[c].to_numpy(np.int64) for c in ("first", "packs", "base", "offset"))
    ranked = positions(cut, ["length"], [F.col(c) for c in order], "__rank")

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            length, rank = frame["length"].to_numpy(np.int64), frame["rank"].to_numpy(np.int64) - 1
            slot = np.searchsorted(start, (length << 48) + rank, side="right") - 1
            inside = rank - first[slot]
            yield pd.DataFrame({
                "sequence_id": base[slot] + inside % packs[slot],
                "offset": offset[slot] + inside // packs[slot] * length})

    @F.pandas_udf("sequence_id long, offset long")
    def placed(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        yield from place(pd.DataFrame({"length": a, "rank": b}) for a, b in parts)

    out = ranked.withColumn("__at", placed(F.col("length"), F.col("__rank")))
    return out.select(*cut.columns, F.col("__at.sequence_id").alias("sequence_id"), F.col("__at.offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = SIZE) -> DataFrame:
    """Pieces of all documents (``doc_id, text``) with their sequence and place in it.

    Null ids and repeated rows are packed like any other; an empty table gives no piece. Documents longer than a
    sequence are cut every ``size`` ids, so only their last piece shares a sequence.
    """
    stage = Stage(docs.sparkSession, "packing")
    return pack(stage(pieces(docs, tokenizer_path, size)), size)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op10_packing")
def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids."""
    return pack_documents(read(spark, folder, "documents"), default_tokenizer())
