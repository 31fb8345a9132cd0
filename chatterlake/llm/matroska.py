"""Matroska files: written from payloads, and read back into packet tables.

The reader walks EBML elements (variable-length ids and sizes, unknown sizes included),
clusters, simple blocks and block groups with every kind of lacing, and the cue index.
A packet is one frame: its track, timestamp and byte range in the file.

Defined cases. A null or empty media column has no packets and no tracks. Bytes that are
no Matroska, or end too early, give the packets that are whole, and `error` says what
broke; no row fails the job. Extra columns pass by unread. Equal media, equal rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element ids, fixed by the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, VOID = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B, 0xEC
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO, RATE, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
TIMESTAMP_SCALE, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x2AD7B1, 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
PARENTS = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_TRACK_POSITIONS}
#: Children that end a cluster or segment of unknown size.
TOP = {INFO, TRACKS, CLUSTER, CUES, SEGMENT, EBML}
#: One 8-bit sample is one tick: 8000 samples a second, 125 microseconds each.
SAMPLE_RATE, TICK_NS = 8000, 125_000
FRAME, FRAMES_A_BLOCK, BLOCKS_A_CLUSTER = 1024, 8, 4


def coded_size(n: int, width: int = 0) -> bytes:
    """A variable-length size; the value of all ones is kept for `unknown`."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(eid: int, body: bytes) -> bytes:
    return eid.to_bytes((eid.bit_length() + 7) // 8, "big") + coded_size(len(body)) + body


def number(eid: int, n: int) -> bytes:
    return element(eid, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes]) -> tuple[int, bytes]:
    """Lacing flag and head for the frames of one block: none, fixed-size, or EBML with signed differences."""
    sizes = [len(f) for f in frames]
    if len(frames) == 1:
        return 0, b""
    if len(set(sizes)) == 1:
        return 0x04, bytes([len(frames) - 1])
    head = bytes([len(frames) - 1]) + coded_size(sizes[0])
    for was, n in zip(sizes, sizes[1:-1]):
        step = n - was
        width = next(w for w in range(1, 9) if abs(step) < (1 << 7 * w - 1) - 1)
        head += coded_size(step + (1 << 7 * width - 1) - 1, width)
    return 0x06, head


def write_media(payload: bytes) -> bytes:
    """A one-track audio file whose 8-bit samples are the payload's bytes, with cues to its clusters."""
    head = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(0x4282, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
    info = element(INFO, number(TIMESTAMP_SCALE, TICK_NS) + element(0x4D80, b"chatterlake") + element(0x5741, b"chatterlake"))
    audio = element(AUDIO, element(RATE, struct.pack(">d", SAMPLE_RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, FRAME * TICK_NS) + audio))
    body, cues = [info, tracks], []
    at = len(info) + len(tracks)
    step, whole = FRAME * FRAMES_A_BLOCK, FRAME * FRAMES_A_BLOCK * BLOCKS_A_CLUSTER
    for start in range(0, len(payload), whole):
        part = [number(TIMESTAMP, start)]
        for b in range(start, min(start + whole, len(payload)), step):
            frames = [payload[f : f + FRAME] for f in range(b, min(b + step, start + whole, len(payload)), FRAME)]
            flag, lace = laced(frames)
            part.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", b - start, 0x80 | flag) + lace + b"".join(frames)))
        cues.append(element(CUE_POINT, number(CUE_TIME, start) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, at))))
        body.append(element(CLUSTER, b"".join(part)))
        at += len(body[-1])
    body.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(body))


def read_vint(data: bytes, at: int, keep_marker: bool) -> tuple[int, int, bool]:
    """Value, place after it, and whether all value bits are ones (an unknown size)."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no element at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"element head cut at byte {at}")
    value = int.from_bytes(data[at : at + width], "big")
    bits = value & ((1 << 7 * width) - 1)
    return (value if keep_marker else bits), at + width, bits == (1 << 7 * width) - 1


def frame_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[int, list[int]]:
    """Where a block's frames begin, and their sizes; lacing: 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if lacing == 0:
        return at, [end - at]
    n, at, sizes = data[at] + 1, at + 1, []
    if lacing == 2:
        if (end - at) % n:
            raise ValueError(f"uneven fixed lacing at byte {at}")
        return at, [(end - at) // n] * n
    for k in range(n - 1):
        if lacing == 1:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            was = at
            size, at, _ = read_vint(data, at, False)
            if k:
                size = sizes[-1] + size - ((1 << 7 * (at - was) - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"lacing beyond its block at byte {at}")
    return at, sizes


def read_media(data: bytes) -> dict:
    """tracks: number -> codec, type, rate, channels, depth. packets: (track, cluster, timestamp in
    ticks, start, end, keyframe, lacing). cues: (time, track, cluster's byte). scale: ns a tick."""
    out: dict = {"tracks": {}, "packets": [], "cues": [], "clusters": [], "scale": 1_000_000, "error": None}
    segment, cluster, track, cue = 0, -1, {}, {}
    stack: list[tuple[int, int, bool]] = [(0, len(data), False)]  # id, end, unknown size
    at = 0
    try:
        while at < len(data):
            while at >= stack[-1][1] and len(stack) > 1:
                stack.pop()
            began = at
            eid, at, _ = read_vint(data, at, True)
            size, at, unknown = read_vint(data, at, False)
            while stack[-1][2] and (eid in (EBML, SEGMENT) or (stack[-1][0] == CLUSTER and eid in TOP)):
                stack.pop()
            end = stack[-1][1] if unknown else at + size
            if end > stack[-1][1]:
                if eid not in PARENTS:
                    raise ValueError(f"element at byte {began} ends beyond its parent")
                out["error"], end = f"element at byte {began} ends beyond its parent", stack[-1][1]
            body = lambda: int.from_bytes(data[at:end], "big")  # noqa: E731, B023
            if eid == SEGMENT:
                segment = at
            elif eid == CLUSTER:
                out["clusters"].append([began, 0])
                cluster += 1
            elif eid == TRACK_ENTRY:
                track = {"codec": None, "type": None, "rate": 8000.0, "channels": 1, "depth": None}
            elif eid == CUE_POINT:
                cue = {}
            if eid in PARENTS:
                stack.append((eid, end, unknown))
                continue
            if eid == TIMESTAMP_SCALE:
                out["scale"] = body()
            elif eid == TRACK_NUMBER:
                out["tracks"][body()] = track
            elif eid == CODEC_ID:
                track["codec"] = data[at:end].rstrip(b"\0").decode("ascii", "replace")
            elif eid in (TRACK_TYPE, CHANNELS, BIT_DEPTH, DEFAULT_DURATION):
                track[{TRACK_TYPE: "type", CHANNELS: "channels", BIT_DEPTH: "depth", DEFAULT_DURATION: "duration"}[eid]] = body()
            elif eid == RATE:
                track["rate"] = struct.unpack(">d" if end - at == 8 else ">f", data[at:end])[0]
            elif eid == TIMESTAMP:
                out["clusters"][-1][1] = body()
            elif eid == CUE_TIME:
                cue["time"] = body()
            elif eid == CUE_TRACK:
                cue["track"] = body()
            elif eid == CUE_CLUSTER_POSITION:
                out["cues"].append((cue.get("time"), cue.get("track"), segment + body()))
            elif eid in (SIMPLE_BLOCK, BLOCK):
                number_, p, _ = read_vint(data, at, False)
                shift, flags = struct.unpack(">hB", data[p : p + 3])
                lacing = flags >> 1 & 3
                p, sizes = frame_sizes(data, p + 3, end, lacing)
                tick = out["tracks"].get(number_, {}).get("duration", 0) // out["scale"]
                for k, n in enumerate(sizes):  # laced frames follow one another by the track's default duration
                    out["packets"].append((number_, cluster, out["clusters"][-1][1] + shift + k * tick, p, p + n, bool(flags & 0x80) and eid == SIMPLE_BLOCK, lacing))
                    p += n
            at = end
    except (ValueError, IndexError, struct.error) as why:
        out["error"] = str(why)
    return out


PACKETS = "track long, cluster long, timestamp_ns long, byte_start long, byte_end long, keyframe boolean, lacing int"


def packet_table(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """A row for each packet of each media value: id, packet number, track, cluster, time and byte range."""
    kind = media.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column(0), batch.column(1), strict=True):
                found = read_media(data.as_py() or b"")
                for a in range(0, len(found["packets"]), 10_000):
                    part = found["packets"][a : a + 10_000]
                    cols = list(zip(*part, strict=True))
                    cols[2] = [t * found["scale"] for t in cols[2]]
                    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int32()]
                    yield pa.record_batch([pa.array([key.as_py()] * len(part), batch.column(0).type), pa.array(range(a, a + len(part)), pa.int64()), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["id", "packet", *[x.split()[0] for x in PACKETS.split(", ")]])

    return media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(rows, f"id {kind}, packet long, {PACKETS}")


def padded(payload: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return payload + bytes(-len(payload) % 64 if payload else 64)


def measure(payload: bytes) -> tuple:
    """Stores the payload, reads it back by the packet table and describes what was read."""
    media = write_media(payload)
    found = read_media(media)
    back = b"".join([media[p[3] : p[4]] for p in found["packets"]])
    track = found["tracks"][1]
    last = found["packets"][-1]
    end = last[2] + len(media[last[3] : last[4]])
    feature = (
        f"codec={track['codec']};rate={track['rate']:g};channels={track['channels']};depth={track['depth']};clusters={len(found['clusters'])};packets={len(found['packets'])};"
        f"cues={sum(c[2] == k[0] and c[0] == k[1] for c, k in zip(found['cues'], found['clusters'], strict=True))};duration_ns={end * found['scale']};sum={sum(back)}"
    )
    return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature


MEASURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each whole text as the samples of a Matroska file, described after reading it back. A null text is empty."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = []
            for x in batch.column("payload"):
                data = x.as_buffer().to_pybytes() if x.is_valid else b""
                found.append((len(data), *measure(padded(data))))
            cols = zip(*found, strict=True)
            yield pa.record_batch([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=[x.split()[0] for x in MEASURES.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("payload")).mapInArrow(rows, MEASURES)
