import random
import zlib

import numpy as np
import pytest

from castwise.llm import packing
from tests.llm.conftest import prose

PATH = packing.default_tokenizer()


def whole(text):
    encoder = packing.encoder(PATH)
    return np.array([*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_words_encode_as_whole_texts():
    r = random.Random(3)
    pool = "aAéÉßİΣσςǅ'\"s tT́\u0085 ​　中文12½٣\x1c\x7f\x00\n\r\ví"
    encoder = packing.encoder(PATH)
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    texts += ["a <|endoftext|>b", "<|endoftext|>", "<|startoftext|>x<|endoftext|>'s", "it's 12 o'clock, isn't it?!", prose(1, 300)]
    for t in texts:
        assert encoder.ids(t.encode()) == np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_cache_may_be_small(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 5)
    encoder = packing.Encoder(PATH)
    text = prose(2, 400)
    assert encoder.ids(text.encode()) == whole(text)[:-1].tobytes()
    assert len(encoder.words) <= 5


def test_latin_texts_are_cut_whole_and_only_their_pieces_remembered():
    encoder = packing.Encoder(PATH)
    text = " ".join(f"{a}{b}{c}" for a in ("Été", "run", "ÿes", "²o") for b in ("'s", "12", "", "ß") for c in (".", ",", "!?", "\n"))
    assert encoder.ids(text.encode()) == whole(text)[:-1].tobytes()
    assert not encoder.words and len(encoder.pieces) < 20  # 80 different words
    mixed = text + " “ok” " + text + " <|endoftext|>x"
    assert encoder.ids(mixed.encode()) == whole(mixed)[:-1].tobytes()


def test_latin_pieces_are_those_of_the_tokenizers_rule():
    letters = [chr(i) for i in range(0x250) if packing.LATIN_TEXT.fullmatch(chr(i))]
    r = random.Random(4)
    for text in [*letters, *("".join(r.choices(letters, k=6)) for _ in range(5000))]:
        assert packing.LATIN_PIECE.findall(text.lower()) == packing.PIECE.findall(text.lower())


@pytest.mark.parametrize("seed", range(6))
def test_patterns_hold_every_piece_once(seed):
    r = random.Random(seed)
    size = r.choice([8, 64, 2048])
    histogram = {r.randint(1, size): r.choice([1, 3, 50, 4000]) for _ in range(r.randint(0, 60))}
    patterns = packing.shortest_pack_first(histogram, size)
    placed = {}
    for p in patterns:
        assert p.packs > 0 and 0 < p.used() <= size
        for length, times in p.runs:
            placed[length] = placed.get(length, 0) + times * p.packs
    assert placed == histogram


def test_equal_short_pieces_share_packs():
    assert sum(p.packs for p in packing.shortest_pack_first({100: 2000}, 2048)) == 100


def check(docs, rows, size):
    got = packing.pack_documents(docs, PATH, size).collect()
    expected = []
    for i, t in rows:
        ids = whole(t)
        for at in range(0, len(ids), size):
            part = ids[at: at + size]
            expected.append((str(i), at, len(part), zlib.crc32(part.tobytes()), len(ids)))
    assert sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == sorted(expected)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return sequences


def test_edges(frame, edges):
    for size in (16, 2048):
        check(frame(edges), edges, size)


def test_little_padding(frame):
    rows = [(i, prose(i, 5 + i * 7 % 300)) for i in range(400)]
    sequences = check(frame(rows), rows, 512)
    used = [sum(n for _, n in s) for s in sequences.values()]
    assert sum(512 - u for u in used) < 0.02 * sum(used)


def test_empty(frame):
    assert packing.pack_documents(frame([]), PATH).count() == 0
