"""Media columns as MPEG audio streams.

``store`` puts bytes into the main-data area of MPEG-1 Layer III frames (mono,
32 kHz, variable bit rate) behind an ID3v2 tag and a Xing table; ``inspect``
reads any MPEG audio stream: it skips and parses tags, finds frame headers again
after foreign bytes, verifies each frame's CRC-16, reads the variable-bit-rate
table and gives exact durations and the byte offset of every frame.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import id_text, materialize, slices

#: Fixed values of the MPEG audio format. Bit rates in kbit/s by (version 1?, layer), for the indexes 1 to 14.
BIT_RATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
#: Sample rates in Hz by the header's version bits (3: version 1, 2: version 2, 0: version 2.5).
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

#: Payloads are a positive multiple of this many bytes.
BLOCK = 64
#: Frames of ``store``: header and CRC, then this much side information; bytes of a frame for each kbit/s at 32 kHz.
HEAD, SIDE, PER_KBIT = 6, 17, 4.5
MONO_32K = bytes([0xFF, 0xFA])


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    length: int
    samples: int
    rate: int
    protected: bool
    side: int


@functools.lru_cache(maxsize=4096)
def parse_header(data: bytes) -> Header | None:
    """The frame that four bytes announce; None if they aren't a valid header."""
    word = int.from_bytes(data, "big")
    version, layer, index, rate_index = word >> 19 & 3, 4 - (word >> 17 & 3), word >> 12 & 15, word >> 10 & 3
    if word >> 21 != 0x7FF or version == 1 or layer == 4 or index in (0, 15) or rate_index == 3:
        return None
    first = version == 3
    bits = BIT_RATES[first, layer][index - 1] * 1000
    rate, padding = SAMPLE_RATES[version][rate_index], word >> 9 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    length = (12 * bits // rate + padding) * 4 if layer == 1 else samples // 8 * bits // rate + padding
    mono = (word >> 6 & 3) == 3
    side = 0 if layer != 3 else (17 if mono else 32) if first else (9 if mono else 17)
    return Header(version, layer, length, samples, rate, not word >> 16 & 1, side)


@functools.lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """The frame checksum: polynomial 0x8005, start 0xFFFF, most significant bit first."""
    crc = 0xFFFF
    for b in data:
        crc ^= b << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


@functools.lru_cache(maxsize=16)
def frame_start(index: int) -> tuple[bytes, int]:
    """Header, CRC and empty side information of a frame of ``store``; the frame's length."""
    header = MONO_32K + bytes([index << 4 | 2 << 2, 0xC0])
    side = bytes(SIDE)
    return header + crc16(header[2:] + side).to_bytes(2, "big") + side, parse_header(header).length


def store(payload: bytes) -> bytes:
    """An MPEG stream that holds ``payload``; equal payloads give equal streams."""
    start, full = frame_start(14)
    room = full - len(start)
    n, rest = divmod(len(payload), room)
    block = np.zeros((n, full), np.uint8)
    if n:
        block[:, : len(start)] = np.frombuffer(start, np.uint8)
        block[:, len(start) :] = np.frombuffer(payload, np.uint8, n * room).reshape(n, room)
    frames = block.tobytes()
    if rest:
        index = next(i for i in range(1, 15) if frame_start(i)[1] - len(frame_start(i)[0]) >= rest)
        start, length = frame_start(index)
        frames += start + payload[n * room :] + bytes(length - len(start) - rest)
    count = n + (rest > 0)
    head, length = frame_start(6)
    total = length + len(frames)
    toc = bytes(min(255, 256 * (length + full * (k * count // 100)) // total) for k in range(100))
    table = b"Xing" + struct.pack(">III", 7, count, total) + toc
    text = b"\0payload\0" + b"%d:%d" % (len(payload), zlib.crc32(payload))
    tag = b"TXXX" + struct.pack(">IH", len(text), 0) + text
    size = len(tag)
    size7 = bytes([size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127])
    return b"ID3\x03\0\0" + size7 + tag + head + table + bytes(length - len(head) - len(table)) + frames


@dataclass
class Stream:
    """What ``inspect`` finds. ``offsets``: the first byte of each audio frame."""

    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    samples: dict[int, int] = field(default_factory=dict)
    table: dict[str, int] | None = None
    checked: int = 0
    broken: int = 0
    skipped: int = 0
    payload: bytes = b""


#: Text encodings of ID3v2 by their first byte (fixed values of the format).
ENCODINGS = ("latin-1", "utf-16", "utf-16-be", "utf-8")


def syncsafe(data: bytes) -> int:
    """Four bytes of seven bits each."""
    return sum(x << 7 * k for k, x in enumerate(reversed(data)))


def tag_text(body: bytes) -> list[str]:
    """The strings of a text frame, in the encoding that its first byte names."""
    kind = ENCODINGS[body[0]] if body and body[0] < len(ENCODINGS) else "latin-1"
    wide = kind.startswith("utf-16")
    data = body[1:]
    end = b"\0\0" if wide else b"\0"
    parts, at = [], 0
    while at <= len(data):
        stop = data.find(end, at)
        while wide and stop >= 0 and (stop - at) % 2:
            stop = data.find(end, stop + 1)
        stop = len(data) if stop < 0 else stop
        parts.append(data[at:stop].decode(kind, "replace"))
        at = stop + len(end)
    return parts


def read_tags(data: bytes, out: Stream) -> int:
    """Parse the ID3v2 tag (versions 2.3 and 2.4); the position behind it."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    version, flags = data[3], data[5]
    end = 10 + syncsafe(data[6:10])
    whole = data[10:end]
    if flags & 0x80 and version < 4:  # a zero byte was put behind each 0xFF
        whole = whole.replace(b"\xff\0", b"\xff")
    at = 0
    if flags & 0x40:  # version 2.4 counts the extended header's own size, 2.3 doesn't
        at = syncsafe(whole[:4]) if version >= 4 else 4 + int.from_bytes(whole[:4], "big")
    while at + 10 <= len(whole) and whole[at : at + 4].isalnum():
        name = whole[at : at + 4].decode("latin-1")
        size = syncsafe(whole[at + 4 : at + 8]) if version >= 4 else int.from_bytes(whole[at + 4 : at + 8], "big")
        body = whole[at + 10 : at + 10 + size]
        if name[0] == "T":
            first, *more = tag_text(body)
            key, value = (first, more[0] if more else "") if name == "TXXX" else (name, first)
            out.tags[key] = value
        at += 10 + size
    return min(end + (10 if flags & 0x10 and version >= 4 else 0), len(data))


#: Fields of the 128 bytes of an ID3v1 tag behind its first three (fixed values of the format).
ID3V1 = (("title", 30), ("artist", 30), ("album", 30), ("year", 4), ("comment", 30))


def read_last_tag(data: bytes, out: Stream) -> None:
    at = 3
    for name, size in ID3V1:
        value = data[at : at + size].split(b"\0")[0].decode("latin-1").strip()
        if value:
            out.tags.setdefault(name, value)
        at += size


def allocation_widths(head: Header, mode: int) -> list[int]:
    """Bits of the allocation field of each subband (fixed values of the format)."""
    if head.layer == 1:
        return [4] * 32
    if head.version != 3:
        return [4] * 4 + [3] * 7 + [2] * 19
    bits = head.length * head.rate // 144_000 // (1 if mode == 3 else 2)  # about kbit/s for each channel
    if head.rate != 48_000 and bits >= 95:
        return [4] * 11 + [3] * 12 + [2] * 7
    if bits >= 55:
        return [4] * 11 + [3] * 12 + [2] * 4
    return [4] * 2 + [3] * (10 if head.rate == 32_000 else 6)


def protected_bits(frame: bytes, head: Header) -> str:
    """What a frame's checksum covers, as binary digits, in layers I and II: the header's
    last two bytes, then the allocation and in layer II the scale factor selection."""
    header = f"{int.from_bytes(frame[2:4], 'big'):016b}"
    mode, extension = frame[3] >> 6, frame[3] >> 4 & 3
    channels, joint = (1 if mode == 3 else 2), (4 * (extension + 1) if mode == 1 else 32)
    digits = "".join(f"{x:08b}" for x in frame[HEAD : HEAD + 96])
    at = selected = 0
    for band, width in enumerate(allocation_widths(head, mode)):
        for _ in range(channels if band < joint else 1):
            used = "1" in digits[at : at + width]
            selected += used * (1 if band < joint else channels)
            at += width
    return header + digits[: at + (2 * selected if head.layer == 2 else 0)]


def bits_crc(digits: str) -> int:
    """``crc16`` of binary digits, of which there may be a broken byte."""
    whole = len(digits) // 8 * 8
    crc = crc16(int(digits[:whole], 2).to_bytes(whole // 8, "big"))
    for x in digits[whole:]:
        crc = (crc << 1 ^ 0x8005 if (crc >> 15 ^ int(x)) & 1 else crc << 1) & 0xFFFF
    return crc


def read_table(frame: bytes, head: Header) -> dict[str, int] | None:
    """Frames and bytes of a Xing, Info or VBRI table."""
    for at in (4 + head.side, HEAD + head.side):
        if frame[at : at + 4] in (b"Xing", b"Info"):
            flags = int.from_bytes(frame[at + 4 : at + 8], "big")
            at, found = at + 8, {"entries": 100 if flags & 4 else 0}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    found[name] = int.from_bytes(frame[at : at + 4], "big")
                    at += 4
            return found
    if frame[36:40] == b"VBRI":
        total, frames, entries = struct.unpack(">IIH", frame[46:56])
        return {"bytes": total, "frames": frames, "entries": entries}
    return None


def inspect(data: bytes) -> Stream:
    """Walk the stream frame by frame. Empty or foreign data give a stream without frames."""
    out = Stream()
    at = read_tags(data, out)
    end = len(data)
    last_tag = end - 128 if data[-128:-125] == b"TAG" else -1
    body, synced = [], False
    while at + 4 <= end:
        if at == last_tag and synced:  # only where frames end; elsewhere the same bytes may be payload
            read_last_tag(data[at:], out)
            break
        head = parse_header(data[at : at + 4])
        ok = head is not None and at + head.length <= end
        if ok and not synced:  # a chance sync rarely has another header where its frame ends
            after = at + head.length
            ok = after + 4 > end or after == last_tag or parse_header(data[after : after + 4]) is not None
        if not ok:
            found = data.find(b"\xff", at + 1, end)
            found = end if found < 0 else found
            out.skipped, at, synced = out.skipped + found - at, found, False
            continue
        synced = True
        begin = at + 4
        if head.protected:
            out.checked += 1
            begin = at + HEAD
            whole = head.layer == 3  # its covered part is whole bytes, whose checksum is remembered
            crc = crc16(data[at + 2 : at + 4] + data[begin : begin + head.side]) if whole else bits_crc(protected_bits(data[at : at + head.length], head))
            out.broken += crc != int.from_bytes(data[at + 4 : begin], "big")
        table = read_table(data[at : at + head.length], head) if not out.offsets and out.table is None else None
        if table is not None:
            out.table = table
        else:
            out.offsets.append(at)
            out.samples[head.rate] = out.samples.get(head.rate, 0) + head.samples
            body.append(data[begin + head.side : at + head.length])
        at += head.length
    out.payload = b"".join(body)
    return out


def payload_of(stream: Stream) -> bytes:
    """The stored bytes; the tag has their number and checksum."""
    size, crc = map(int, stream.tags["payload"].split(":"))
    payload = stream.payload[:size]
    if len(payload) != size or zlib.crc32(payload) != crc:
        raise ValueError("the stream doesn't hold the payload that its tag announces")
    return payload


def text_payload(text: str) -> bytes:
    data = text.encode()
    return data + bytes(-len(data) % BLOCK if data else BLOCK)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, media)``: every text (null: empty) padded and stored as a stream, row by row."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in slices(batch):
                texts = x.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [x.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([store(text_payload(t)) for t in texts], pa.binary())],
                    ["doc_id", "n_bytes", "media"],
                )

    return id_text(docs, id_col, text_col).mapInArrow(write, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, media binary")


INSPECTED = "frames long, samples long, sample_rate int, duration_s double, crc_checked long, crc_broken long, skipped_bytes long, table_frames long, tags map<string,string>, seek_offsets array<long>"


def inspect_media(media: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """Durations, checks, tags and seek offsets of a column of streams (null: no frames)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = inspect(data or b"")
                rate = max(s.samples, default=None)
                seconds = sum(n / r for r, n in sorted(s.samples.items()))
                rows.append((key, len(s.offsets), sum(s.samples.values()), rate, seconds, s.checked, s.broken, s.skipped, (s.table or {}).get("frames"), list(s.tags.items()), s.offsets))
            kinds = [batch.schema[0].type, pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.list_(pa.int64())]
            names = ["id", *(x.strip().split(" ")[0] for x in INSPECTED.replace("map<string,string>", "map").split(","))]
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    picked = media.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{media_col}`").alias("media"))
    return picked.mapInArrow(read, f"id {picked.schema['id'].dataType.simpleString()}, {INSPECTED}").withColumnRenamed("id", id_col)


def media_digest(docs: DataFrame) -> DataFrame:
    """Store all texts as streams in a written table, read it back and digest payload, stream and features.

    Null and empty texts give 64 zero bytes; equal texts give equal values; a null
    id and repeated rows are kept; an empty table gives no rows.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in slices(batch, 2):
                rows = []
                for n, media in zip(x.column(1).to_pylist(), x.column(2).to_pylist()):
                    s = inspect(media)
                    p = payload_of(s)
                    (rate, samples), *_ = s.samples.items()
                    feature = f"mpeg1-l3 {rate} Hz; {samples}/{rate} s; {len(s.offsets)} frames of {s.table['frames']}; crc {s.checked - s.broken}/{s.checked}; first {s.offsets[0]}; last {s.offsets[-1]}"
                    rows.append((n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature, samples / rate, s.offsets))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.int64()))
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "duration_s", "seek_offsets"]
                yield pa.RecordBatch.from_arrays([x.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names)

    stored = materialize(store_texts(docs), "media", compression="zstd")
    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.mapInArrow(
        digest,
        f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_s double, seek_offsets array<long>",
    )
