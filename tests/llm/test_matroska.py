import hashlib
import random
import zlib

import pytest

from castwise.llm import matroska as m


@pytest.mark.parametrize("kind", [m.NO_LACE, m.XIPH_LACE, m.FIXED_LACE, m.EBML_LACE])
@pytest.mark.parametrize("n", [64, 128, 64 * 129, 64 * 5000])
def test_round_trip(kind, n):
    payload = random.Random(n).randbytes(n)
    data = m.mux(payload, kind)
    found = m.parse(data)
    assert m.payload_of(data, found) == payload
    assert found.doc_type == "matroska" and found.tracks[1]["codec"] == "A_PCM/INT/LIT" and found.tracks[1]["bits"] == 8
    assert len(found.packets) == n // 64
    assert [t for _, t, *_ in found.packets] == [i * 8_000_000 for i in range(n // 64)]
    assert sorted(c for _, _, c in found.cues) == sorted({p[5] for p in found.packets})


@pytest.mark.parametrize("kind", [m.XIPH_LACE, m.EBML_LACE])
def test_frames_of_different_sizes(kind):
    r = random.Random(2)
    frames = [r.randbytes(r.choice([0, 1, 64, 254, 255, 256, 5000, 70_000])) for _ in range(60)]
    body = m._lace(frames, kind)
    assert [body[a:b] for a, b in m._frames(body, 0, len(body), kind)] == frames


def file_with(*clusters: bytes, tracks: bytes = b"") -> bytes:
    return m.element(m.EBML, b"") + m.element(m.SEGMENT, tracks + b"".join(clusters))


def test_block_groups_unknown_sizes_and_skipped_elements():
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, m.block(2, -3, [b"abc"], m.NO_LACE)) + m.element(0xFB, b"\x01"))
    body = m.unsigned(m.CLUSTER_TIME, 1000) + m.element(0xEC, b"\0" * 9) + group
    open_cluster = m.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + body
    data = m.element(m.EBML, b"") + m.SEGMENT.to_bytes(4, "big") + b"\xff" + open_cluster + m.element(
        m.CLUSTER, m.unsigned(m.CLUSTER_TIME, 2000) + m.element(m.SIMPLE_BLOCK, m.block(2, 5, [b"de"], m.NO_LACE)))
    found = m.parse(data)
    assert [(t, time, data[at: at + n], key) for t, time, at, n, key, _ in found.packets] == [
        (2, 997_000_000, b"abc", False), (2, 2_005_000_000, b"de", True)]
    assert found.clusters == 2


@pytest.mark.parametrize("data", [
    b"", b"\0", b"no media at all", m.element(m.EBML, b""), m.mux(b"x" * 64)[:-40],
    file_with(m.element(m.CLUSTER, m.element(m.SIMPLE_BLOCK, b"\x81\0"))),
    file_with(m.element(m.CLUSTER, m.element(m.SIMPLE_BLOCK, b"\x81\0\0\x04\x02abcd"))),
])
def test_malformed(data):
    with pytest.raises(m.MediaError):
        m.parse(data)


def test_packet_table(spark):
    good = m.mux(b"a" * 640)
    rows = [(1, good, 7), (2, None, 7), (3, b"", 7), (4, b"junk", 7), (1, good, 7), (None, m.mux(b"b" * 64), 7)]
    got = m.packet_table(spark.createDataFrame(rows, "id bigint, media binary, packet int"), "id", "media").collect()
    assert sorted(r["id"] or 0 for r in got) == [0] + [1] * 20
    for r in got:
        if r["id"] == 1:
            assert good[r["byte_offset"]: r["byte_offset"] + r["byte_length"]] == b"a" * 64 and r["cued"] and r["track"] == 1
    assert m.packet_table(spark.createDataFrame([], "id bigint, media binary"), "id", "media").count() == 0


def test_documents(frame, edges):
    from pyspark.sql import functions as F

    from castwise.llm.common import utf8

    docs = frame(edges).select("doc_id", F.col("text").alias("t"), utf8(F.col("text")).alias("data"))
    got = docs.select("t", m.probe(m.media_of("data")).alias("p")).select("t", "p.*").collect()
    for r in got:
        raw = (r["t"] or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_sha256"] == hashlib.sha256(m.mux(payload)).hexdigest() and r["feature"]
