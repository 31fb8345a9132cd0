from __future__ import annotations

import hashlib
import random
import struct
import zlib

from chatterlake.llm import matroska as M


def test_round_trip_over_sizes():
    rng = random.Random(1)
    for n in (0, 1, 63, 64, 65, 1024, 1088, 8192, 8256, 33000, 200_000):
        payload = M.padded(rng.randbytes(n))
        media = M.write_media(payload)
        found = M.read_media(media)
        assert found["error"] is None and len(payload) % 64 == 0 and payload
        assert b"".join(media[p[3] : p[4]] for p in found["packets"]) == payload
        assert [c[2] for c in found["cues"]] == [k[0] for k in found["clusters"]]
        starts = [p[2] for p in found["packets"]]
        assert starts == sorted(starts) and starts[0] == 0


def test_hand_made_file_with_unknown_sizes_xiph_lacing_and_block_groups():
    unknown = b"\x01" + b"\xff" * 7
    xiph = b"\x81" + struct.pack(">hB", 5, 0x02) + bytes([2, 255, 45, 3]) + b"a" * 300 + b"b" * 3 + b"c" * 7
    even = b"\x82" + struct.pack(">hB", -2, 0x84) + bytes([1]) + b"d" * 8
    ebml = b"\x81" + struct.pack(">hB", 0, 0x06) + bytes([3]) + M.coded_size(10) + bytes([0x80 | (63 - 4), 0x80 | (63 + 2)]) + b"e" * 10 + b"f" * 6 + b"g" * 8 + b"h"
    first = b"\x1f\x43\xb6\x75" + unknown + M.number(M.TIMESTAMP, 100) + M.element(M.BLOCK_GROUP, M.element(M.BLOCK, xiph)) + M.element(M.VOID, b"zz")
    second = b"\x1f\x43\xb6\x75" + unknown + M.number(M.TIMESTAMP, 200) + M.element(M.SIMPLE_BLOCK, even) + M.element(M.SIMPLE_BLOCK, ebml)
    media = M.element(M.EBML, M.number(0x4286, 1)) + b"\x18\x53\x80\x67" + unknown + first + second
    found = M.read_media(media)
    assert found["error"] is None
    assert [(p[0], p[1], p[2], media[p[3] : p[4]], p[5], p[6]) for p in found["packets"]] == [
        (1, 0, 105, b"a" * 300, False, 1), (1, 0, 105, b"b" * 3, False, 1), (1, 0, 105, b"c" * 7, False, 1),
        (2, 1, 198, b"d" * 4, True, 2), (2, 1, 198, b"d" * 4, True, 2),
        (1, 1, 200, b"e" * 10, False, 3), (1, 1, 200, b"f" * 6, False, 3), (1, 1, 200, b"g" * 8, False, 3), (1, 1, 200, b"h", False, 3)]


def test_packet_table_survives_broken_media(spark):
    good = M.write_media(M.padded(b"hello" * 20000))
    rows = [(1, bytearray(good)), (2, bytearray(good[: len(good) // 2])), (3, bytearray(b"no media")), (4, None), (5, bytearray())]
    frame = M.packet_table(spark.createDataFrame(rows, "k long, m binary"), "k", "m")
    per = {}
    for r in frame.collect():
        per.setdefault(r.id, []).append(r)
    whole = sorted(per[1], key=lambda r: r.packet)
    assert b"".join(good[r.byte_start : r.byte_end] for r in whole) == M.padded(b"hello" * 20000)
    assert whole[1].timestamp_ns == 1024 * M.TICK_NS
    assert set(per) == {1, 2} and 0 < len(per[2]) < len(whole)


def test_texts(spark):
    texts = [(1, None), (2, ""), (3, "é" * 40), (4, "x" * 64), (5, "long " * 40000), (6, "é" * 40)]
    got = {r.doc_id: r for r in M.text_media(spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, payload int")).collect()}
    for i, t in texts:
        data = (t or "").encode()
        full = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
    assert got[3][1:] == got[6][1:] and got[1][1:] == got[2][1:]
    assert M.text_media(spark.createDataFrame([], "doc_id long, text string")).count() == 0
