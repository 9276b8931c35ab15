"""Media columns in Matroska: a reader of EBML elements, clusters, lacing and cues, and a writer of PCM audio.

``packets`` turns a binary column into a packet table; ``read_cues`` into a table of cue points. ``store`` keeps any
bytes losslessly as 8-bit mono PCM, which ``demux`` gives back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element ids of the Matroska specification (RFC 9559).
EBML, VOID, CRC = 0x1A45DFA3, 0xEC, 0xBF
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, DEFAULT_DURATION, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x23E383, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION, CUE_RELATIVE_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1, 0xF0
TOP_LEVEL = {0x114D9B74, INFO, TRACKS, CLUSTER, CUES, 0x1941A469, 0x1043A770, 0x1254C367}

#: A sample lasts a tick of 125 microseconds: 8000 samples a second.
TICK, RATE = 125_000, 8000
FRAME, FRAMES, BLOCKS = 512, 8, 8


class Malformed(ValueError):
    """The bytes aren't the Matroska that their elements say."""


@dataclass
class Packet:
    track: int
    timestamp_ns: int
    offset: int
    size: int
    keyframe: bool
    cluster: int
    duration_ns: int | None = None


@dataclass
class Media:
    doc_type: str = ""
    scale: int = 1_000_000
    duration: float | None = None
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    cues: list[dict] = field(default_factory=list)
    clusters: int = 0


# Reading


def _vint(data: memoryview, at: int, end: int, keep_marker: bool) -> tuple[int, int]:
    """The number at ``at`` and where it ends; -1 for the size that says unknown."""
    if at >= end or not data[at]:
        raise Malformed(f"no variable-length number at {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise Malformed(f"a number is cut off at {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return value, at + width
    value &= (1 << 7 * width) - 1
    return (-1 if value == (1 << 7 * width) - 1 else value), at + width


def elements(data: memoryview, at: int, end: int, inside: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(id, where it begins, where its content begins, where that ends) of each element from ``at`` to ``end``.

    An element of unknown size ends where its parent does, or before the next top-level element if it is a cluster.
    """
    while at < end:
        begin = at
        name, at = _vint(data, at, end, True)
        if inside == CLUSTER and name in TOP_LEVEL:
            return
        size, at = _vint(data, at, end, False)
        if size < 0:
            stop = _cluster_end(data, at, end) if name == CLUSTER else end
        else:
            stop = at + size
        if stop > end:
            raise Malformed(f"the element at {begin} is cut off")
        yield name, begin, at, stop
        at = stop


def _cluster_end(data: memoryview, at: int, end: int) -> int:
    for _, _, _, stop in elements(data, at, end, CLUSTER):
        at = stop
    return at


def _uint(data: memoryview, s: int, e: int) -> int:
    return int.from_bytes(data[s:e], "big")


def _float(data: memoryview, s: int, e: int) -> float:
    return {0: lambda: 0.0, 4: lambda: struct.unpack(">f", data[s:e])[0], 8: lambda: struct.unpack(">d", data[s:e])[0]}[e - s]()


def laces(data: memoryview, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """(offset, size) of a block's frames; lacing: 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if not lacing:
        return [(at, end - at)]
    if at >= end:
        raise Malformed(f"a laced block is cut off at {at}")
    frames, at = data[at] + 1, at + 1
    if lacing == 2:
        if (end - at) % frames:
            raise Malformed(f"frames at {at} aren't of one size")
        sizes = [(end - at) // frames] * frames
    else:
        sizes = []
        for k in range(frames - 1):
            if lacing == 1:
                size = 0
                while True:
                    if at >= end:
                        raise Malformed(f"lace sizes are cut off at {at}")
                    size, at = size + data[at], at + 1
                    if data[at - 1] != 255:
                        break
            else:
                start = at
                size, at = _vint(data, at, end, False)
                if k:  # a signed difference
                    width = at - start
                    size = sizes[-1] + (size if size >= 0 else (1 << 7 * width) - 1) - ((1 << (7 * width - 1)) - 1)
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or at + sum(sizes) > end:
        raise Malformed(f"lace sizes at {at} don't fit")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def demux(content: bytes) -> Media:
    """All tracks, packets and cues of a file; raises Malformed where bytes and elements don't agree."""
    data, media = memoryview(content), Media()
    top = list(elements(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise Malformed("no EBML header")
    for name, _, s, e in elements(data, top[0][2], top[0][3]):
        if name == DOC_TYPE:
            media.doc_type = bytes(data[s:e]).rstrip(b"\0").decode("ascii", "replace")
    for name, _, segment, stop in top:
        if name == SEGMENT:
            _segment(data, segment, stop, media)
    return media


def _segment(data: memoryview, segment: int, stop: int, media: Media) -> None:
    for name, begin, s, e in elements(data, segment, stop):
        if name == INFO:
            for kind, _, a, b in elements(data, s, e):
                if kind == TIMESTAMP_SCALE:
                    media.scale = _uint(data, a, b)
                elif kind == DURATION:
                    media.duration = _float(data, a, b)
        elif name == TRACKS:
            for kind, _, a, b in elements(data, s, e):
                if kind == TRACK_ENTRY:
                    track = _track(data, a, b)
                    media.tracks[track.get("number", 0)] = track
        elif name == CLUSTER:
            _cluster(data, s, e, begin - segment, media)
        elif name == CUES:
            for kind, _, a, b in elements(data, s, e):
                if kind == CUE_POINT:
                    _cue(data, a, b, media)


def _track(data: memoryview, s: int, e: int) -> dict:
    out: dict = {}
    for name, _, a, b in elements(data, s, e):
        if name in (TRACK_NUMBER, TRACK_UID, TRACK_TYPE, DEFAULT_DURATION, FLAG_LACING):
            out[{TRACK_NUMBER: "number", TRACK_UID: "uid", TRACK_TYPE: "type", DEFAULT_DURATION: "default_duration", FLAG_LACING: "lacing"}[name]] = _uint(data, a, b)
        elif name == CODEC_ID:
            out["codec"] = bytes(data[a:b]).decode("ascii", "replace")
        elif name == AUDIO:
            for kind, _, c, d in elements(data, a, b):
                if kind == SAMPLING_FREQUENCY:
                    out["rate"] = _float(data, c, d)
                elif kind in (CHANNELS, BIT_DEPTH):
                    out["channels" if kind == CHANNELS else "bits"] = _uint(data, c, d)
    return out


def _cluster(data: memoryview, s: int, e: int, position: int, media: Media) -> None:
    media.clusters += 1
    time = 0
    for name, _, a, b in elements(data, s, e, CLUSTER):
        if name == TIMESTAMP:
            time = _uint(data, a, b)
        elif name == SIMPLE_BLOCK:
            _block(data, a, b, time, position, media, None, None)
        elif name == BLOCK_GROUP:
            block = duration = None
            key = True
            for kind, _, c, d in elements(data, a, b):
                if kind == BLOCK:
                    block = (c, d)
                elif kind == BLOCK_DURATION:
                    duration = _uint(data, c, d)
                elif kind == REFERENCE_BLOCK:
                    key = False
            if block:
                _block(data, *block, time, position, media, key, duration)


def _block(data: memoryview, s: int, e: int, time: int, position: int, media: Media, key: bool | None, duration: int | None) -> None:
    number, at = _vint(data, s, e, False)
    if at + 3 > e:
        raise Malformed(f"the block at {s} is cut off")
    relative, flags = struct.unpack(">hB", data[at : at + 3])
    frames = laces(data, at + 3, e, flags >> 1 & 3)
    each = media.tracks.get(number, {}).get("default_duration") or (duration * media.scale // len(frames) if duration is not None else None)
    for k, (offset, size) in enumerate(frames):
        start = (time + relative) * media.scale + k * (each or 0)
        media.packets.append(Packet(number, start, offset, size, bool(flags & 0x80) if key is None else key, position, each))


def _cue(data: memoryview, s: int, e: int, media: Media) -> None:
    time, places = 0, []
    for name, _, a, b in elements(data, s, e):
        if name == CUE_TIME:
            time = _uint(data, a, b)
        elif name == CUE_TRACK_POSITIONS:
            place = {}
            for kind, _, c, d in elements(data, a, b):
                if kind in (CUE_TRACK, CUE_CLUSTER_POSITION, CUE_RELATIVE_POSITION):
                    place[{CUE_TRACK: "track", CUE_CLUSTER_POSITION: "cluster", CUE_RELATIVE_POSITION: "relative"}[kind]] = _uint(data, c, d)
            places.append(place)
    media.cues += [{"timestamp_ns": time * media.scale, **p} for p in places]


# Writing


def _size(n: int, width: int | None = None) -> bytes:
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return ((1 << 7 * width) | n).to_bytes(width, "big")


def _element(name: int, content: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + _size(len(content)) + content


def _number(name: int, value: int) -> bytes:
    return _element(name, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _laced(frames: list[bytes]) -> tuple[int, bytes]:
    """The lacing flags and content of a block: fixed lacing for frames of one size, EBML lacing for others."""
    if len(frames) == 1:
        return 0, frames[0]
    if len({*map(len, frames)}) == 1:
        return 2, bytes([len(frames) - 1]) + b"".join(frames)
    sizes = _size(len(frames[0]))
    for before, now in zip(frames[:-2], frames[1:-1], strict=True):
        difference = len(now) - len(before)
        width = next(w for w in range(1, 9) if abs(difference) < (1 << (7 * w - 1)) - 1)
        sizes += _size(difference + (1 << (7 * width - 1)) - 1, width)
    return 3, bytes([len(frames) - 1]) + sizes + b"".join(frames)


def mux(samples: bytes) -> bytes:
    """A Matroska file with one track of unsigned 8-bit mono PCM at 8 kHz: equal samples, equal bytes."""
    header = _element(EBML, b"".join([_number(EBML_VERSION, 1), _number(EBML_READ_VERSION, 1), _number(EBML_MAX_ID, 4), _number(EBML_MAX_SIZE, 8), _element(DOC_TYPE, b"matroska"), _number(DOC_TYPE_VERSION, 4), _number(DOC_TYPE_READ_VERSION, 2)]))
    info = _element(INFO, b"".join([_number(TIMESTAMP_SCALE, TICK), _element(DURATION, struct.pack(">d", float(len(samples)))), _element(MUXING_APP, b"millrace"), _element(WRITING_APP, b"millrace")]))
    audio = _element(AUDIO, _element(SAMPLING_FREQUENCY, struct.pack(">d", float(RATE))) + _number(CHANNELS, 1) + _number(BIT_DEPTH, 8))
    tracks = _element(TRACKS, _element(TRACK_ENTRY, b"".join([_number(TRACK_NUMBER, 1), _number(TRACK_UID, 1), _number(TRACK_TYPE, 2), _number(FLAG_LACING, 1), _number(DEFAULT_DURATION, FRAME * TICK), _element(CODEC_ID, b"A_PCM/INT/LIT"), audio])))
    parts, position, cues = [info, tracks], len(info) + len(tracks), []
    for start in range(0, len(samples), FRAME * FRAMES * BLOCKS):
        blocks = [_number(TIMESTAMP, start)]
        for at in range(start, min(len(samples), start + FRAME * FRAMES * BLOCKS), FRAME * FRAMES):
            frames = [samples[k : k + FRAME] for k in range(at, min(len(samples), at + FRAME * FRAMES), FRAME)]
            lacing, content = _laced(frames)
            blocks.append(_element(SIMPLE_BLOCK, _size(1) + struct.pack(">hB", at - start, 0x80 | lacing << 1) + content))
        cluster = _element(CLUSTER, b"".join(blocks))
        cues.append(_element(CUE_POINT, _number(CUE_TIME, start) + _element(CUE_TRACK_POSITIONS, _number(CUE_TRACK, 1) + _number(CUE_CLUSTER_POSITION, position) + _number(CUE_RELATIVE_POSITION, len(blocks[0])))))
        parts.append(cluster)
        position += len(cluster)
    parts.append(_element(CUES, b"".join(cues)))
    return header + _element(SEGMENT, b"".join(parts))


# Tables


def _mapped(df: DataFrame, id_col: str, media_col: str, schema: str, rows) -> DataFrame:
    """Rows of a file, made one by one, with the id before them; a file that can't be read gives none but its error."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, content in zip(batch.column(0), batch.column(1), strict=True):
                cols = list(zip(*rows(content.as_py() or b""), strict=True))
                for at in range(0, len(cols[0]) if cols else 0, 65536):
                    some = [c[at : at + 65536] for c in cols]
                    yield pa.RecordBatch.from_pylist([dict(zip([id_col, *names], (key.as_py(), *r), strict=True)) for r in zip(*some, strict=True)], pa.schema([(id_col, batch.schema.field(0).type), *[(n, kinds[t]) for n, t in (f.split() for f in schema.split(", "))]]))

    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    return df.select(F.col(id_col).alias("k"), F.col(media_col).alias("m")).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, {schema}")


def packets(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """The packet table of a binary column: packet, track, timestamp_ns, duration_ns, byte_offset, byte_size, keyframe, cluster, error.

    Null and empty content and content that can't be parsed give one row with the error alone; a file without packets
    gives no row. Repeated rows give their packets again.
    """

    def rows(content: bytes):
        try:
            for n, p in enumerate(demux(content).packets):
                yield n, p.track, p.timestamp_ns, p.duration_ns, p.offset, p.size, p.keyframe, p.cluster, None
        except Malformed as e:
            yield None, None, None, None, None, None, None, None, str(e)

    return _mapped(df, id_col, media_col, "packet long, track long, timestamp_ns long, duration_ns long, byte_offset long, byte_size long, keyframe boolean, cluster long, error string", rows)


def read_cues(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """The cue points of a binary column: timestamp_ns, track, cluster_position, relative_position; none where the content can't be parsed."""

    def rows(content: bytes):
        try:
            found = demux(content).cues
        except Malformed:
            return
        for c in found:
            yield c["timestamp_ns"], c.get("track"), c.get("cluster"), c.get("relative")

    return _mapped(df, id_col, media_col, "timestamp_ns long, track long, cluster_position long, relative_position long", rows)


def payload(text: str | None, unit: int = 64) -> bytes:
    """The text's UTF-8 with bytes 0 up to a positive multiple of ``unit``; null is empty."""
    data = (text or "").encode()
    return data + bytes(-len(data) % unit if data else unit)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each whole text's payload as a Matroska file. Equal texts give equal bytes; null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                texts = [t.as_py() for t in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([mux(payload(t)) for t in texts], pa.binary())], names=["id", "n_bytes", "media"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def read_back(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, payload, feature): the samples that the packets of a file hold, in order, and a line of figures about them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, said = [], []
            for content in batch.column(1):
                content = content.as_py()
                m = demux(content)
                data.append(b"".join([content[p.offset : p.offset + p.size] for p in m.packets]))
                said.append(_figures(m, data[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary()), pa.array(said)], names=["id", "payload", "feature"])

    return media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(run, f"id {media.schema[id_col].dataType.simpleString()}, payload binary, feature string").withColumnRenamed("id", id_col)


def _figures(m: Media, samples: bytes) -> str:
    x = np.frombuffer(samples, np.uint8).astype(np.int32) - 128
    peak = int(np.abs(x).max()) if len(x) else 0
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    energy = int((x.astype(np.int64) ** 2).sum())
    return f"packets={len(m.packets)} clusters={m.clusters} cues={len(m.cues)} end_ns={round((m.duration or 0) * m.scale)} peak={peak} energy={energy} crossings={crossings}"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every whole text as a file, parses that file again, and gives digests of both: n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Each file is made, read and let go in turn, so a task holds one text's file at a time. Null is empty; repeated rows
    and equal texts have equal values. An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for text in batch.column(1):
                text = text.as_py()
                content = mux(payload(text))
                media = demux(content)
                back = b"".join([content[p.offset : p.offset + p.size] for p in media.packets])
                values = (len((text or "").encode()), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(content), hashlib.sha256(content).hexdigest(), _figures(media, back))
                for c, v in zip(cols, values, strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["id", *DIGESTS])

    schema = ", ".join([f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}", *[f"{n} {t}" for n, t in DIGESTS.items()]])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lambda b: (x.rename_columns([id_col, *DIGESTS]) for x in run(b)), schema)


DIGESTS = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}
