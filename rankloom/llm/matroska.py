"""Matroska media columns: packet tables out of EBML elements, and a writer that lays samples out as such a file.

A binary column holds whole files. `packets` gives a row for each frame: track, time, byte range, key flag, lacing and
cluster; `tracks` and `cues` give the tables beside it. The parser walks variable-length ids and sizes, masters of
unknown size (a live stream's segment and clusters), SimpleBlocks and BlockGroups, and all four ways of lacing; elements
that it doesn't know, Void and CRC-32 among them, are stepped over. It reads byte ranges only, so payloads aren't copied.

Null and empty files have no packets. A file that breaks off keeps what is whole before the break, and `error` says where
it ends; nothing raises. Repeated rows and ids give a set of rows each. Other columns go through, whatever their names.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from . import common

# Element ids of the format.
EBML, SEGMENT, VOID, DOC_TYPE = 0x1A45DFA3, 0x18538067, 0xEC, 0x4282
INFO, TIMESTAMP_SCALE, DURATION = 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, LACING_FLAG, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS = 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469
#: Elements of a segment; one of them ends a cluster of unknown size.
TOP = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, CHAPTERS, TAGS, ATTACHMENTS}
#: Ways of lacing, by their two bits in a block's flags.
LACINGS = ("none", "xiph", "fixed", "ebml")

PACKETS = "struct<packet:long,track:long,timestamp_ns:long,duration_ns:long,start:long,size:long,key:boolean,lacing:string,block:long,cluster:long>"
TRACK_ROWS = "struct<track:long,kind:long,codec:string,default_duration_ns:long,rate:double,channels:long,bits:long>"
CUE_ROWS = "struct<timestamp_ns:long,track:long,cluster:long>"


class Packet(NamedTuple):
    """A frame. block, cluster: where their elements begin in the file; start, size: the frame's bytes."""

    packet: int
    track: int
    timestamp_ns: int
    duration_ns: int | None
    start: int
    size: int
    key: bool
    lacing: str
    block: int
    cluster: int


@dataclass
class Track:
    track: int = 0
    kind: int = 0
    codec: str = ""
    default_duration_ns: int | None = None
    rate: float = 8000.0
    channels: int = 1
    bits: int | None = None


@dataclass
class Media:
    """What a file holds; `error` is empty, or says why the walk ended before the end."""

    tracks: dict[int, Track] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    blocks: int = 0
    scale: int = 1_000_000
    duration: float | None = None
    error: str = ""


class Broken(ValueError):
    """Bytes that aren't EBML, or end too early."""


def vint(data, at: int, end: int, keep: bool = False) -> tuple[int, int]:
    """(value, place behind): a variable-length integer; an id keeps its length marker. -1: all ones, size unknown."""
    if at >= end:
        raise Broken(f"no byte at {at}")
    first = data[at]
    length = 9 - first.bit_length()
    if length > 8 or at + length > end:
        raise Broken(f"no integer at {at}")
    whole = int.from_bytes(data[at : at + length], "big")
    if keep:
        return whole, at + length
    value = whole & ((1 << 7 * length) - 1)
    return (-1 if value == (1 << 7 * length) - 1 else value), at + length


def elements(data, at: int, end: int, stop=frozenset()):
    """(id, start of the element, start and end of its content) of a master's children, up to an id of `stop`."""
    while at < end:
        began = at
        name, at = vint(data, at, end, True)
        if name in stop:
            return
        size, at = vint(data, at, end)
        if size < 0:
            if name not in (SEGMENT, CLUSTER):
                raise Broken(f"element at {began} has no size")
            close = end if name == SEGMENT else _cluster_end(data, at, end)
        elif at + size > end:
            if name not in (SEGMENT, CLUSTER):
                raise Broken(f"element at {began} ends behind its master")
            close = end  # cut off: what is whole in it is still there
        else:
            close = at + size
        yield name, began, at, close
        at = close


def _cluster_end(data, at: int, end: int) -> int:
    """Where a cluster of unknown size ends: before the next element of the segment, or before what is broken."""
    while at < end:
        try:
            name, begun = vint(data, at, end, True)
            if name in TOP or name == EBML:
                return at
            size, begun = vint(data, begun, end)
        except Broken:
            return end
        if size < 0 or begun + size > end:
            return end
        at = begun + size
    return end


def unsigned(data, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def real(data, at: int, end: int) -> float:
    return {4: lambda: struct.unpack(">f", data[at:end])[0], 8: lambda: struct.unpack(">d", data[at:end])[0], 0: lambda: 0.0}.get(end - at, lambda: float("nan"))()


def frames(data, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """(start, size) of a block's frames, behind its flags."""
    if lacing == 0:
        return [(at, end - at)]
    if at >= end:
        raise Broken(f"no frame count at {at}")
    n, at = data[at] + 1, at + 1
    if lacing == 2:
        size, rest = divmod(end - at, n)
        if rest:
            raise Broken(f"frames at {at} have no equal size")
        return [(at + k * size, size) for k in range(n)]
    sizes = []
    if lacing == 1:
        for _ in range(n - 1):
            size = 0
            while True:
                if at >= end:
                    raise Broken(f"no frame size at {at}")
                size, byte, at = size + data[at], data[at], at + 1
                if byte < 255:
                    break
            sizes.append(size)
    elif n > 1:
        size, at = vint(data, at, end)
        sizes.append(size)
        for _ in range(n - 2):
            began = at
            step, at = vint(data, at, end)
            length = at - began
            step = (1 << 7 * length) - 1 if step < 0 else step  # all ones is a plain value here
            size += step - ((1 << 7 * length - 1) - 1)
            sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Broken(f"frames at {at} end behind their block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def _block(data, media: Media, at: int, end: int, began: int, cluster: int, time: int, key: bool | None, duration: int | None) -> None:
    """Appends the frames of a block; key: None for a SimpleBlock, whose flags tell."""
    track, at = vint(data, at, end)
    if at + 3 > end:
        raise Broken(f"block at {began} has no header")
    relative, flags = struct.unpack(">hB", data[at : at + 3])
    way = flags >> 1 & 3
    found = frames(data, at + 3, end, way)
    own = media.tracks.get(track)
    each = own.default_duration_ns if own else None
    if duration is not None:
        each = duration * media.scale // len(found)
    start = (time + relative) * media.scale
    for k, (place, size) in enumerate(found):
        media.packets.append(Packet(len(media.packets), track, start + k * (each or 0), each, place, size, flags >= 128 if key is None else key, LACINGS[way], began, cluster))
    media.blocks += 1


def _cluster(data, media: Media, began: int, at: int, end: int) -> None:
    time = 0
    media.clusters.append(began)
    for name, start, a, b in elements(data, at, end):
        if name == TIMESTAMP:
            time = unsigned(data, a, b)
        elif name == SIMPLE_BLOCK:
            _block(data, media, a, b, start, began, time, None, None)
        elif name == BLOCK_GROUP:
            inner, key, duration = None, True, None
            for child, child_start, c, d in elements(data, a, b):
                if child == BLOCK:
                    inner = child_start, c, d
                elif child == REFERENCE_BLOCK:
                    key = False
                elif child == BLOCK_DURATION:
                    duration = unsigned(data, c, d)
            if inner:
                _block(data, media, inner[1], inner[2], inner[0], began, time, key, duration)


def _track(data, at: int, end: int) -> Track:
    own = Track()
    for name, _, a, b in elements(data, at, end):
        if name == TRACK_NUMBER:
            own.track = unsigned(data, a, b)
        elif name == TRACK_TYPE:
            own.kind = unsigned(data, a, b)
        elif name == CODEC_ID:
            own.codec = bytes(data[a:b]).rstrip(b"\0").decode("ascii", "replace")
        elif name == DEFAULT_DURATION:
            own.default_duration_ns = unsigned(data, a, b)
        elif name == AUDIO:
            for child, _, c, d in elements(data, a, b):
                if child == SAMPLING_FREQUENCY:
                    own.rate = real(data, c, d)
                elif child == CHANNELS:
                    own.channels = unsigned(data, c, d)
                elif child == BIT_DEPTH:
                    own.bits = unsigned(data, c, d)
    return own


def _segment(data, media: Media, at: int, end: int) -> None:
    base = at
    for name, began, a, b in elements(data, at, end, {EBML}):
        if name == INFO:
            for child, _, c, d in elements(data, a, b):
                if child == TIMESTAMP_SCALE:
                    media.scale = unsigned(data, c, d)
                elif child == DURATION:
                    media.duration = real(data, c, d)
        elif name == TRACKS:
            for child, _, c, d in elements(data, a, b):
                if child == TRACK_ENTRY:
                    own = _track(data, c, d)
                    media.tracks[own.track] = own
        elif name == CLUSTER:
            _cluster(data, media, began, a, b)
        elif name == CUES:
            for child, _, c, d in elements(data, a, b):
                if child == CUE_POINT:
                    time, places = 0, []
                    for inner, _, e, f in elements(data, c, d):
                        if inner == CUE_TIME:
                            time = unsigned(data, e, f)
                        elif inner == CUE_TRACK_POSITIONS:
                            got = {x: unsigned(data, y, z) for x, _, y, z in elements(data, e, f)}
                            places.append((got.get(CUE_TRACK, 0), got.get(CUE_CLUSTER_POSITION, 0)))
                    media.cues += [(time * media.scale, track, base + place) for track, place in places]


def parse(data) -> Media:
    """All segments of a file. data: bytes, or any buffer."""
    media, view = Media(), memoryview(data or b"").cast("B")
    try:
        for name, began, a, b in elements(view, 0, len(view)):
            if name == SEGMENT:
                _segment(view, media, a, b)
            elif name not in (EBML, VOID) and not media.clusters and began == 0:
                raise Broken("no EBML header")
    except Broken as e:
        media.error = str(e)
    return media


# --- writing ---


def size_bytes(value: int, length: int | None = None) -> bytes:
    """A size as variable-length integer; all ones are kept for unknown sizes."""
    need = length or next(k for k in range(1, 9) if value < (1 << 7 * k) - 1)
    return (value | 1 << 7 * need).to_bytes(need, "big")


def element(name: int, content: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + size_bytes(len(content)) + content


def number(name: int, value: int) -> bytes:
    return element(name, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def laced(parts: list[bytes], way: str) -> tuple[bytes, bytes]:
    """(what stands before the frames of a block, the frames)."""
    body = b"".join(parts)
    if way == "none":
        return b"", body
    head = bytes([len(parts) - 1])
    sizes = [len(x) for x in parts[:-1]]
    if way == "xiph":
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes)
    elif way == "ebml" and sizes:
        head += size_bytes(sizes[0])
        for before, n in zip(sizes, sizes[1:], strict=False):
            need = next(k for k in range(1, 9) if abs(n - before) < (1 << 7 * k - 1) - 1)
            head += size_bytes(n - before + (1 << 7 * need - 1) - 1, need)
    return head, body


def block(track: int, relative: int, parts: list[bytes], way: str = "none", key: bool = True, simple: bool = True) -> bytes:
    head, body = laced(parts, way)
    flags = LACINGS.index(way) << 1 | (128 if key and simple else 0)
    return size_bytes(track) + struct.pack(">hB", relative, flags) + head + body


def audio_file(samples: bytes, rate: int = 8000, frame: int = 192, lace: int = 8, cluster: int = 512) -> bytes:
    """8-bit mono samples as one PCM track: `lace` frames of `frame` samples a block, `cluster` frames a cluster, each cued.

    Frames of one block have equal sizes (fixed-size lacing); what is left is a frame of its own. The samples come back
    as they were, and equal samples give equal files.
    """
    each = frame * 10**9 // rate
    head = element(EBML, element(DOC_TYPE, b"matroska"))
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(samples) * 1000 / rate)))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", rate)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    entry = number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + number(LACING_FLAG, 1) + number(DEFAULT_DURATION, each) + audio
    parts, points, at = [info, element(TRACKS, element(TRACK_ENTRY, entry))], [], 0
    at = sum(map(len, parts))
    step, span = frame * lace, frame * cluster
    for begin in range(0, len(samples), span):
        base = begin // frame * each // 1_000_000
        content = [number(TIMESTAMP, base)]
        for k in range(begin, min(begin + span, len(samples)), step):
            chunk = samples[k : min(k + step, begin + span)]
            whole = len(chunk) // frame
            time = round(k // frame * each / 1_000_000) - base
            if whole:
                content.append(element(SIMPLE_BLOCK, block(1, time, [chunk[: whole * frame][x : x + frame] for x in range(0, whole * frame, frame)], "fixed" if whole > 1 else "none")))
            if rest := chunk[whole * frame :]:
                content.append(element(SIMPLE_BLOCK, block(1, round((k // frame + whole) * each / 1_000_000) - base, [rest])))
        points.append(element(CUE_POINT, number(CUE_TIME, base) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, at))))
        parts.append(element(CLUSTER, b"".join(content)))
        at += len(parts[-1])
    parts.append(element(CUES, b"".join(points)))
    return head + element(SEGMENT, b"".join(parts))


# --- on tables ---


def _tables(df: DataFrame, media: str, name: str, schema: str, rows) -> DataFrame:
    """Adds `name`, an array of rows of each file; keep it an array or explode it."""

    kind = to_arrow_type(common.field("x", f"array<{schema}>").dataType)

    def make():
        def run(batch):
            column = batch.column(batch.schema.get_field_index(media))
            return [pa.array([rows(parse(x.as_buffer())) if x.is_valid else [] for x in column], kind)]

        return run

    return common.map_arrow(df, make, [common.field(name, f"array<{schema}>")])


def packets(df: DataFrame, media: str, name: str = "packets") -> DataFrame:
    """Adds an array of the frames of the files in column `media`, in file order. `name` may not be a column already."""
    return _tables(df, media, name, PACKETS, lambda m: [p._asdict() for p in m.packets])


def tracks(df: DataFrame, media: str, name: str = "tracks") -> DataFrame:
    return _tables(df, media, name, TRACK_ROWS, lambda m: [vars(t) for t in m.tracks.values()])


def cues(df: DataFrame, media: str, name: str = "cues") -> DataFrame:
    """Adds an array of the cues; `cluster` is the place of the cluster in the file."""
    return _tables(df, media, name, CUE_ROWS, lambda m: [dict(zip(("timestamp_ns", "track", "cluster"), c, strict=True)) for c in m.cues])


def audio_files(df: DataFrame, text: str, media: str = "media", size: str = "n_bytes", unit: int = 192) -> DataFrame:
    """Adds `media`, texts as audio files, and `size`, their UTF-8 bytes without what fills them up to a multiple of `unit`.

    Bytes 32 fill up; a null or empty text becomes one unit of them. Neither name may be a column already.
    """

    def make():
        def run(batch):
            files, sizes = [], []
            for text_bytes in common.text_of(batch, text).cast(pa.large_binary()):
                raw = text_bytes.as_py()
                files.append(audio_file(raw + b" " * (max(unit, -(-len(raw) // unit) * unit) - len(raw)), frame=unit))
                sizes.append(len(raw))
            return [pa.array(files, pa.binary()), pa.array(sizes, pa.int64())]

        return run

    return common.map_arrow(df, make, [common.field(media, "binary"), common.field(size, "long")], keep=[c for c in df.columns if c != text])


FEATURES = "struct<codec:string,rate:double,packets:long,blocks:long,clusters:long,cues:long,cued:long,duration_ns:long,low:long,high:long,total:long,squares:long,crossings:long,error:string>"


def _features(media: Media, samples: bytes) -> dict:
    """Counts of the container, and extremes, sum, squares and sign changes of 8-bit samples around 128."""
    wave = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    first, last = media.packets[0] if media.packets else None, max(media.packets, key=lambda p: p.timestamp_ns, default=None)
    own = media.tracks.get(first.track, Track()) if first else Track()
    whole = (last.timestamp_ns + (last.duration_ns or 0) - first.timestamp_ns) if first else 0
    out = {"codec": own.codec, "rate": own.rate, "packets": len(media.packets), "blocks": media.blocks, "clusters": len(media.clusters), "cues": len(media.cues), "cued": len({c for _, _, c in media.cues} & set(media.clusters)), "duration_ns": whole, "error": media.error}
    return out | {"low": int(wave.min(initial=127)), "high": int(wave.max(initial=-128)), "total": int(wave.sum()), "squares": int((wave * wave).sum()), "crossings": int(np.count_nonzero(np.diff(wave >= 0)))}


def samples(df: DataFrame, media: str, payload: str = "payload", features: str = "features", track: int = 1) -> DataFrame:
    """Replaces `media` by `payload`, the bytes of a track's packets in the order of their times, and `features` (a struct).

    Bytes come from the ranges in the packet table. A null file has an empty payload. Neither name may be a column already.
    """
    kind = to_arrow_type(common.field("x", FEATURES).dataType)

    def make():
        def run(batch):
            payloads, told = [], []
            for x in batch.column(batch.schema.get_field_index(media)):
                data = memoryview(x.as_buffer() if x.is_valid else b"")
                found = parse(data)
                ranges = sorted((p for p in found.packets if p.track == track), key=lambda p: p.timestamp_ns)
                payloads.append(b"".join(data[p.start : p.start + p.size] for p in ranges))
                told.append(_features(found, payloads[-1]))
            return [pa.array(payloads, pa.binary()), pa.array(told, kind)]

        return run

    return common.map_arrow(df, make, [common.field(payload, "binary"), common.field(features, FEATURES)], keep=[c for c in df.columns if c != media])
