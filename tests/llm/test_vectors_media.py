"""Exact top-k against brute force, and MPEG streams."""

import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pytest

from folioscope.llm import mpeg_audio as m
from folioscope.llm import pivot_index as index
from folioscope.llm import vector_topk as v
from tests.llm.cases import TEXTS, documents, rows_of, table


def brute(rows, k=10, every=100):
    good = [(i, tuple(math.floor(1024 * float(np.float32(y))) for y in x)) for i, x in rows if i is not None and x is not None and all(y is not None and math.isfinite(y) for y in x)]
    out = []
    for at, (qi, q) in enumerate(good):
        if qi % every == 0:
            scores = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, x)))), i) for other, (i, x) in enumerate(good) if other != at and len(x) == len(q))
            out += [(qi, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, x, 0, "clash", "clash") for i, x in rows], "vec_id long, embedding array<float>, label int, v string, pivot string")


def test_table(spark, sf):
    docs = table(spark, sf, "embeddings")
    assert rows_of(v.top_k(docs)) == brute([tuple(r) for r in docs.select("vec_id", "embedding").collect()])


def test_clusters_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 16)
    monkeypatch.setattr(index, "QUERIES", 2)
    monkeypatch.setattr(index, "SAMPLE", 50)
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(7)]
    rows = [(i, [c + rng.gauss(0, 0.02) for c in rng.choice(centres)]) for i in range(900)]
    rows += [(1000 + i, [0.5] * 6) for i in range(200)]  # ties
    rows += [(2000, None), (2001, [None] * 6), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (2100, [0.0] * 6), (2200, []), (2300, [1.0, 2.0]), (2301, [1.0, 3.0]), (-100, [9.0] * 6), (2400, [1e4] * 6)]
    rows += [rows[3], rows[3], rows[0], rows[0], (200, [1.0] * 6), (2500, [3e38] * 6), (2501, [-3e38] * 6)]
    shares = []
    assert rows_of(v.top_k(vectors(spark, rows).repartition(7), shares=shares)) == brute(rows)
    assert len(shares) == 3  # one pass for each dimension; the huge vectors make all lengths alike, so that no bound helps here


def test_large_components_are_taken_as_they_are(spark):
    rows = [(100, [1.0, 0.0]), (1, [20000.0, 0.0]), (2, [30000.0, 0.0]), (200, [2.0**31, 1.0]), (3, [2.0**40, -(2.0**41)]), (4, [2.0**40, 2.0**42])]
    found = rows_of(v.top_k(vectors(spark, rows)))
    assert found == brute(rows)
    assert (100, 4, 2, 31_457_280_000) in found and (100, 5, 1, 20_971_520_000) in found


def test_waves_leave_far_annuli_out(spark, monkeypatch):
    """On clusters most vectors are never compared; on uniform directions in many dimensions no bound helps."""
    monkeypatch.setattr(index, "BLOCK", 32)
    monkeypatch.setattr(index, "SAMPLE", 200)
    rng = np.random.default_rng(2)
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).tolist()
    centres = rng.normal(size=(40, 16))
    rows = list(enumerate(unit(centres[rng.integers(0, 40, 3000)] + 0.05 * rng.normal(size=(3000, 16)))))
    shares = []
    assert rows_of(v.top_k(vectors(spark, rows), shares=shares)) == brute(rows)
    assert shares[0] < 0.25


def test_few_and_none(spark):
    assert v.top_k(vectors(spark, [])).collect() == []
    assert rows_of(v.top_k(vectors(spark, [(100, [1.0]), (1, [2.0])]))) == [(100, 1, 1, 1024 * 2048)]
    assert v.top_k(vectors(spark, [(100, [1.0])])).collect() == []


def test_store_round_trip_and_features(spark):
    found = rows_of(m.media_digest(documents(spark, extra=True)))
    for row, text in zip(found, TEXTS):
        data = (text or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        assert row[1:5] == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = m.store(payload)
        assert row[5:7] == (len(stored), hashlib.sha256(stored).hexdigest())
        assert row[9] == m.inspect(stored).offsets and row[8] == 1152 * len(row[9]) / 32_000
    same = [r[1:] for r, t in zip(found, TEXTS) if t == "same text here"]
    assert len(same) == 2 and same[0] == same[1]
    assert m.media_digest(documents(spark, [])).collect() == []
    assert [r[0] for r in rows_of(m.media_digest(documents(spark, ["a", "a"], ids=[None, 3])))] == [None, 3]


def test_table_round_trip(spark, sf):
    docs = table(spark, sf, "documents")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    for r in m.media_digest(docs).collect():
        data = texts[r.doc_id].encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        assert (r.payload_bytes, r.payload_sha256) == (len(payload), hashlib.sha256(payload).hexdigest())


@pytest.mark.parametrize("n", [64, 640, 64 * 100, 64 * 3001])
def test_streams(n):
    payload = random.Random(n).randbytes(n)
    data = m.store(payload)
    s = m.inspect(data)
    assert m.payload_of(s) == payload
    assert s.broken == 0 and s.skipped == 0 and s.checked == len(s.offsets) + 1 and s.table["frames"] == len(s.offsets)
    assert all(m.parse_header(data[a : a + 4]) for a in s.offsets) and sum(s.samples.values()) == 1152 * len(s.offsets)
    # foreign bytes in front, a broken checksum and a closing tag
    damaged = bytearray(data)
    damaged[s.offsets[0] + 10] ^= 1
    t = m.inspect(b"\x00\xff\xfbjunk" + bytes(damaged) + b"TAG" + bytes(125))
    assert t.broken == 1 and len(t.offsets) == len(s.offsets) and t.skipped > 0
    # foreign bytes between frames: headers are found again
    if len(s.offsets) < 3:
        return
    cut = s.offsets[-1]
    u = m.inspect(data[:cut] + b"\xff" * 3 + b"noise" * 7 + data[cut:])
    assert len(u.offsets) in (len(s.offsets), len(s.offsets) - 1) and u.skipped == 38


@pytest.mark.parametrize("mark", [b"TAG", b"ID3", b"ID3\x03\0\0\0\0\0\x09", b"Xing", b"VBRI", b"\xff\xfb", m.frame_start(14)[0]])
def test_payloads_that_look_like_parts_of_a_stream(mark):
    """Marks of tags, tables and frames are payload wherever they stand, also 128 bytes before the end."""
    for n in (64, 192, 448, 1408):
        for at in range(n - len(mark) + 1):
            payload = b"x" * at + mark + b"x" * (n - at - len(mark))
            s = m.inspect(m.store(payload))
            assert m.payload_of(s) == payload and s.skipped == 0 and set(s.tags) == {"payload"}


def test_text_with_tag_before_its_end(spark):
    texts = ["x" * at + "TAG" + "x" * (n - at - 3) for n in (200, 300) for at in range(n - 3)]
    found = sorted(m.media_digest(documents(spark, texts)).collect(), key=lambda r: r.doc_id)
    assert [r.payload_sha256 for r in found] == [hashlib.sha256(t.encode() + bytes(-len(t) % 64)).hexdigest() for t in texts]


def test_other_headers_and_tables():
    head = m.parse_header(bytes([0xFF, 0xFB, 0x90, 0x00]))  # version 1, layer III, 128 kbit/s, 44.1 kHz
    assert (head.length, head.samples, head.rate, head.protected, head.side) == (417, 1152, 44100, False, 32)
    low = m.parse_header(bytes([0xFF, 0xF3, 0x40, 0xC0]))  # version 2, layer III, 32 kbit/s, 22.05 kHz, mono
    assert (low.length, low.samples, low.rate, low.side) == (104, 576, 22050, 9)
    one = m.parse_header(bytes([0xFF, 0xFF, 0x10, 0x00]))  # version 1, layer I, 32 kbit/s
    assert (one.length, one.samples) == (32 * 12000 // 44100 * 4, 384)
    assert all(m.parse_header(bytes(x)) is None for x in ([0xFF, 0xFB, 0xF0, 0], [0xFF, 0xFB, 0, 0], [0xFF, 0xFB, 0x9C, 0], [0xFF, 0xE9, 0x90, 0], [0, 0, 0, 0]))
    frame = bytes([0xFF, 0xFB, 0x90, 0x00]) + bytes(413)
    vbri = frame[:36] + b"VBRI" + bytes(6) + struct.pack(">IIH", 834, 2, 5) + frame[56:]
    s = m.inspect(vbri + frame * 2)
    assert s.table == {"bytes": 834, "frames": 2, "entries": 5} and s.offsets == [417, 834] and s.samples == {44100: 2304}
    assert m.inspect(b"").offsets == [] and m.inspect(b"no audio at all" * 50).offsets == []
    assert m.crc16(b"123456789") == 0xAEE7


def test_inspect_column(spark):
    rows = [(1, m.store(bytes(64)), "x"), (2, None, "x"), (3, b"", "x"), (4, b"noise", "x")]
    df = spark.createDataFrame(rows, "clip long, media binary, frames string")
    found = {r.clip: r for r in m.inspect_media(df, "clip").collect()}
    assert [found[i].frames for i in (1, 2, 3, 4)] == [1, 0, 0, 0]
    assert found[1].duration_s == 1152 / 32000 and len(found[1].seek_offsets) == 1 and found[1].crc_checked == 2 and found[4].skipped_bytes >= 1


def test_tags_of_all_versions():
    def frame(name, body, safe):
        n = len(body)
        return name + (bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) if safe else struct.pack(">I", n)) + bytes(2) + body

    def tag(version, flags, data):
        n = len(data)
        return b"ID3" + bytes([version, 0, flags, n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + data

    long = "é" * 150  # more than 127 bytes, where the two ways to count differ
    utf16, utf8 = b"\x01" + long.encode("utf-16"), b"\x03" + long.encode()
    text = b"\x01" + "键".encode("utf-16") + b"\0\0" + "值".encode("utf-16")
    old = tag(3, 0, frame(b"TIT2", utf16, False) + frame(b"TXXX", text, False) + bytes(20))
    new = tag(4, 0x40, bytes([0, 0, 0, 6, 1, 0]) + frame(b"TIT2", utf8, True) + frame(b"TPE1", b"\x02" + "x".encode("utf-16-be"), True))
    audio = m.store(bytes(64))
    last = b"TAG" + b"Name".ljust(30, b"\0") + b"Who".ljust(30) + bytes(30) + b"1999" + bytes(31)
    for head, expected in ((old, {"TIT2": long, "键": "值"}), (new, {"TIT2": long, "TPE1": "x"})):
        found = m.inspect(head + audio[10 + m.syncsafe(audio[6:10]) :] + last)
        assert found.tags == expected | {"title": "Name", "artist": "Who", "year": "1999"}
        assert len(found.offsets) == 1 and found.skipped == 0 and found.broken == 0


@pytest.mark.parametrize("second,third,fourth,covered", [
    (0xFE, 0x10, 0xC0, 128), (0xFE, 0x40, 0x00, 256), (0xFE, 0x10, 0x50, 2 * 8 * 4 + 24 * 4),  # layer I: mono, stereo, joint from subband 8
    (0xFC, 0x10, 0xC0, 2 * 4 + 6 * 3), (0xFC, 0xC8, 0xC0, 11 * 4 + 12 * 3 + 7 * 2), (0xF4, 0x80, 0xC0, 4 * 4 + 7 * 3 + 19 * 2),  # layer II, mono: 32 kbit/s at 44.1 kHz, 256 at 32, version 2
])
def test_checksums_of_layers_one_and_two(second, third, fourth, covered):
    head = m.parse_header(bytes([0xFF, second, third, fourth]))
    assert head.protected and head.layer in (1, 2)
    silent = bytearray(bytes([0xFF, second, third, fourth]) + bytes(head.length - 4))
    assert len(m.protected_bits(bytes(silent), head)) == 16 + covered
    silent[6] = 0x10  # the first subband is used: layer II has two more bits for it
    digits = m.protected_bits(bytes(silent), head)
    assert len(digits) == 16 + covered + 2 * (head.layer == 2)
    crc = 0xFFFF
    for x in digits:
        crc = (crc << 1 ^ 0x8005 if (crc >> 15 ^ int(x)) & 1 else crc << 1) & 0xFFFF
    silent[4:6] = crc.to_bytes(2, "big")
    found = m.inspect(bytes(silent) * 3)
    assert (len(found.offsets), found.checked, found.broken) == (3, 3, 0)
    silent[7] ^= 0x20
    assert m.inspect(bytes(silent) * 3).broken == 3
