"""Operator 13."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from rankloom.llm import matroska as m
from rankloom.llm.queries import op13_matroska

SF = "/root/testdata/sf0.001"


def unknown(name):
    return name.to_bytes(4, "big") + b"\x01" + b"\xff" * 7


def track(number, kind=2, codec=b"A_PCM/INT/LIT", each=None):
    return m.element(m.TRACK_ENTRY, m.number(m.TRACK_NUMBER, number) + m.number(m.TRACK_TYPE, kind) + m.element(m.CODEC_ID, codec) + (m.number(m.DEFAULT_DURATION, each) if each else b""))


def file(clusters, tracks, head=b""):
    return m.element(m.EBML, m.element(m.DOC_TYPE, b"matroska")) + m.element(m.SEGMENT, head + m.element(m.TRACKS, tracks) + clusters)


def bytes_of(data, found):
    return [bytes(data[p.start : p.start + p.size]) for p in found.packets]


def test_query_stores_whole_texts(spark):
    rows = {r.doc_id: r for r in op13_matroska(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    same = {}
    for d in docs:
        raw, r = (d.text or "").encode(), rows[d.doc_id]
        whole = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-16:]))
        stored = m.audio_file(whole)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        wave = [x - 128 for x in whole]
        frames = len(whole) // 192
        clusters = -(-frames // 512)
        assert r.feature.split(":") == ["A_PCM/INT/LIT", *map(str, (frames, -(-frames // 8), clusters, clusters, clusters, frames * 24_000_000, min(wave), max(wave), sum(wave), sum(x * x for x in wave), sum((a >= 0) != (b >= 0) for a, b in zip(wave, wave[1:], strict=False)))), ""]
        assert same.setdefault(whole, (r.feature, r.media_sha256)) == (r.feature, r.media_sha256)


@pytest.mark.parametrize("way", m.LACINGS)
@pytest.mark.parametrize("seed", range(4))
def test_lacing(way, seed):
    r = random.Random(seed)
    n = 1 if way == "none" else r.choice([1, 2, 3, 40, 256])
    size = r.choice([0, 1, 254, 255, 256, 700])
    parts = [r.randbytes(size if way == "fixed" else r.choice([0, 1, 62, 63, 64, 65, 254, 255, 510, 8000, 8200, r.randint(0, 20000)])) for _ in range(n)]
    data = file(m.element(m.CLUSTER, m.number(m.TIMESTAMP, 1000) + m.element(m.SIMPLE_BLOCK, m.block(200, -7, parts, way))), track(200, each=5_000_000))
    found = m.parse(data)
    assert not found.error and bytes_of(data, found) == parts
    assert [(p.track, p.timestamp_ns, p.duration_ns, p.key, p.lacing) for p in found.packets] == [(200, 993_000_000 + 5_000_000 * k, 5_000_000, True, way) for k in range(n)]


def test_groups_tracks_and_unknown_elements():
    group = lambda t, at, x, more: m.element(m.BLOCK_GROUP, m.element(m.BLOCK, m.block(t, at, x, "xiph" if len(x) > 1 else "none", simple=False)) + more)
    void, odd = m.element(m.VOID, b"\x1a\x45\xdf\xa3" * 3), m.element(0x4DBB, b"xx")
    content = void + m.number(m.TIMESTAMP, 50) + group(1, 0, [b"key", b"frame"], m.number(m.BLOCK_DURATION, 30)) + odd + group(2, 10, [b"later"], m.number(m.REFERENCE_BLOCK, 1)) + m.element(m.SIMPLE_BLOCK, m.block(2, 20, [b"plain"], key=False))
    head = m.element(m.INFO, m.number(m.TIMESTAMP_SCALE, 500_000)) + void
    data = file(m.element(m.CLUSTER, content), track(1) + track(2, 1, b"V_UNCOMPRESSED"), head)
    found = m.parse(data)
    assert bytes_of(data, found) == [b"key", b"frame", b"later", b"plain"] and not found.error
    assert [(p.track, p.timestamp_ns, p.duration_ns, p.key) for p in found.packets] == [(1, 25_000_000, 7_500_000, True), (1, 32_500_000, 7_500_000, True), (2, 30_000_000, None, False), (2, 35_000_000, None, False)]
    assert {t.track: (t.kind, t.codec) for t in found.tracks.values()} == {1: (2, "A_PCM/INT/LIT"), 2: (1, "V_UNCOMPRESSED")}
    assert found.clusters == [found.packets[0].cluster] and found.blocks == 3


def test_live_stream():
    """A segment and clusters of unknown size; each ends where the next begins."""
    cluster = lambda k: unknown(m.CLUSTER) + m.number(m.TIMESTAMP, 100 * k) + m.element(m.SIMPLE_BLOCK, m.block(1, 0, [b"%d" % k]))
    data = m.element(m.EBML, b"") + unknown(m.SEGMENT) + m.element(m.TRACKS, track(1)) + cluster(0) + cluster(1) + cluster(2) + m.element(m.CUES, b"")
    found = m.parse(data)
    assert not found.error and [(x, p.timestamp_ns) for x, p in zip(bytes_of(data, found), found.packets, strict=True)] == [(b"0", 0), (b"1", 100_000_000), (b"2", 200_000_000)]
    assert len(found.clusters) == 3 and [p.cluster for p in found.packets] == found.clusters


def test_sizes_and_reals():
    for value in (0, 1, 126, 127, 128, 16382, 16383, 2**21 - 2, 2**56 - 2):
        for length in (None, 8):
            raw = m.size_bytes(value, length)
            assert m.vint(raw, 0, len(raw)) == (value, len(raw))
    assert m.vint(b"\xff", 0, 1) == (-1, 1) and m.vint(b"\x1a\x45\xdf\xa3", 0, 4, True) == (m.EBML, 4)
    assert m.real(struct.pack(">f", 0.5), 0, 4) == 0.5 and m.real(b"", 0, 0) == 0.0


def test_broken_files_keep_what_is_whole():
    whole = m.audio_file(bytes(range(256)) * 30)
    full = m.parse(whole)
    assert len(full.packets) == 40 and len(full.cues) == 1 and full.cues[0][2] == full.clusters[0]
    r = random.Random(5)
    for at in r.sample(range(len(whole)), 300):
        cut = m.parse(whole[:at])
        assert [p[:7] for p in cut.packets] == [p[:7] for p in full.packets[: len(cut.packets)]]
        assert all(p.start + p.size <= at for p in cut.packets)
        bad = bytearray(whole)
        bad[at] = r.randrange(256)
        assert all(0 <= p.start <= p.start + p.size <= len(bad) for p in m.parse(bytes(bad)).packets)
    for junk in (b"", b"\0", b"\xff" * 40, b"plain text, no file", None):
        assert not m.parse(junk).packets
    assert m.parse(b"plain").error


def test_tables(spark):
    whole = m.audio_file(b"ab" * 960, lace=4, cluster=6)
    rows = [(1, whole, "x"), (1, whole, None), (2, None, "x"), (None, b"", "x"), (3, b"junk", "x")]
    df = spark.createDataFrame(rows, "id long, media binary, payload string").repartition(3)
    got = m.packets(df.select("id", "media"), "media").select("id", "media", F.posexplode("packets").alias("k", "p"))
    table = got.select("id", "k", "p.*", F.expr("substring(media, cast(p.start + 1 as int), cast(p.size as int))").alias("bytes")).collect()
    assert len(table) == 20 and all(r.bytes == b"ab" * 96 and r.packet == r.k and r.id == 1 and r.timestamp_ns == 24_000_000 * r.k for r in table)
    assert {r.lacing for r in table} == {"fixed"} and len({r.cluster for r in table}) == 2 and len({r.block for r in table}) == 3
    assert sorted(len(r.cues) for r in m.cues(df, "media").collect()) == [0, 0, 0, 2, 2]
    assert [[t.codec for t in r.tracks] for r in m.tracks(df, "media").where("id = 1").collect()] == [["A_PCM/INT/LIT"]] * 2
    back = m.samples(df, "media", "payload_", "features").collect()
    assert sorted((str(r.id), r.payload_, r.payload) for r in back if r.id == 1 and r.payload) == [("1", b"ab" * 960, "x")]
    assert {str(r.id): (r.payload_, r.features.packets) for r in back if r.id != 1} == {"2": (b"", 0), "None": (b"", 0), "3": (b"", 0)}
    assert m.packets(df.limit(0), "media").count() == 0


def test_texts(spark):
    rows = [(1, None, "x"), (2, "", None), (3, "é" * 100_000, "x"), (3, "a" * 192, "x"), (None, "𝔘" + "\0" * 200, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string")
    out = m.samples(m.audio_files(df, "text", size="size"), "media").collect()
    want = sorted((t or "").encode() for _, t, _ in rows)
    assert sorted(r.payload[: r.size] for r in out) == want and all(not r.payload[r.size :].strip(b" ") and len(r.payload) % 192 == 0 and r.payload for r in out)
    assert m.samples(m.audio_files(df.limit(0), "text", size="size"), "media").count() == 0
