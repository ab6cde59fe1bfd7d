"""Media columns: MPEG audio that carries any bytes, written as MPEG-1 layer III; all versions and layers are read.

A file is an ID3v2 tag, a first frame with the variable-bitrate table (frame count,
byte count, 100 seek points), silent frames whose ancillary data hold the payload,
and an ID3v1 tag. Every frame has its checksum over header and side information.
Reading parses the tag (ID3v2.2 to 2.4), resynchronises on frame headers (a header
counts only if what follows it is a header of the same stream, or the end), skips
foreign bytes and truncated frames, verifies the checksums of layer III (those of the
other layers cover a part of the coded samples and are passed over), reads the
variable-bitrate table in either form with the fields it says it has, and gives the
exact duration in samples and the offset of every frame. Frames of free bitrate count
as foreign bytes.

The stored form depends on the payload alone, so rows that repeat get equal results and
there are no ties. Null texts count as empty; their payload is 64 zero bytes. Texts of
any length are taken whole. Other columns of the input are ignored. Files that are no
audio, null ones too, have no frames and an empty payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: Fixed values of MPEG audio: kbit/s by index for the pairs of version and layer (layer I of version 1 goes by 32), Hz by index of version 1.
BITRATES = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
KBPS = {
    (1, 1): tuple(range(0, 449, 32)),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): BITRATES,
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)
SAMPLES = 1152
SIDE_MONO = 17
#: Bytes of a protected mono frame before its ancillary data.
HEAD = 4 + 2 + SIDE_MONO
TABLE_KBPS = 64


class Header(NamedTuple):
    size: int
    rate: int
    samples: int
    side: int
    protected: bool
    stream: tuple[int, int, int]


@lru_cache(maxsize=1)
def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1) ^ 0x8005 if c & 0x8000 else c << 1
        table.append(c & 0xFFFF)
    return table


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    table, c = _crc_table(), 0xFFFF
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ table[(c >> 8) ^ b]
    return c


def frame_size(kbps: int, rate: int, padded: bool = False) -> int:
    return 144_000 * kbps // rate + padded


@lru_cache(maxsize=64)
def frame_head(index: int) -> bytes:
    """Header, checksum and empty side information of a mono frame at 44.1 kHz."""
    header = bytes([0xFF, 0xFA, index << 4, 0xC0])
    side = bytes(SIDE_MONO)
    return header + struct.pack(">H", crc16(header[2:] + side)) + side


@lru_cache(maxsize=65536)
def parse_header(header: bytes) -> Header | None:
    """What the four bytes of a frame header tell; None if they are none."""
    if len(header) < 4 or header[0] != 0xFF or header[1] & 0xE0 != 0xE0:
        return None
    version, layer = (4, 0, 2, 1)[header[1] >> 3 & 3], 4 - (header[1] >> 1 & 3)  # 4 stands for version 2.5
    index, rate = header[2] >> 4, header[2] >> 2 & 3
    if not version or layer == 4 or index in (0, 15) or rate == 3:
        return None
    hz = RATES[rate] // version
    kbps, padded = KBPS[min(version, 2), layer][index], header[2] >> 1 & 1
    samples = 384 if layer == 1 else SAMPLES if layer == 2 or version == 1 else SAMPLES // 2
    size = (12_000 * kbps // hz + padded) * 4 if layer == 1 else samples * 125 * kbps // hz + padded
    mono = header[3] >> 6 == 3
    side = (0 if layer != 3 else SIDE_MONO if mono != (version > 1) else 32 if version == 1 else 9)
    return Header(size, hz, samples, side, not header[1] & 1, (version, layer, hz))


def syncsafe(n: int) -> bytes:
    return bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])


def encode(payload: bytes) -> bytes:
    sizes = [frame_size(k, RATES[0]) if k else 0 for k in BITRATES]
    top = len(BITRATES) - 1
    room = sizes[top] - HEAD
    head = frame_head(top)
    n_full = len(payload) // room
    frames = [head + payload[i * room : (i + 1) * room] for i in range(n_full)]
    if rest := payload[n_full * room :]:
        index = next(i for i in range(1, top + 1) if sizes[i] - HEAD >= len(rest))
        frames.append(frame_head(index) + rest + bytes(sizes[index] - HEAD - len(rest)))
    text = b"\x00payload\x00" + str(len(payload)).encode()
    tag = b"TXXX" + struct.pack(">I", len(text)) + b"\x00\x00" + text
    front = b"ID3\x03\x00\x00" + syncsafe(len(tag)) + tag
    table_size = frame_size(TABLE_KBPS, RATES[0])
    offsets, at = [], table_size
    for f in frames:
        offsets.append(at)
        at += len(f)
    total = at
    seek = bytes(min(255, offsets[len(offsets) * p // 100] * 256 // total) if offsets else 0 for p in range(100))
    info = b"Xing" + struct.pack(">III", 7, len(frames), total) + seek
    first = frame_head(BITRATES.index(TABLE_KBPS)) + info
    first += bytes(table_size - len(first))
    return front + first + b"".join(frames) + b"TAG" + bytes(125)


def safe_int(data: bytes) -> int:
    n = 0
    for b in data:
        n = n << 7 | b & 127
    return n


def tag_text(data: bytes) -> list[str]:
    """The strings of a text field by its encoding byte."""
    code = ("latin-1", "utf-16", "utf-16-be", "utf-8")[data[0]] if data and data[0] < 4 else "latin-1"
    return data[1:].decode(code, "replace").split("\0")


def read_tag(data: bytes) -> tuple[int, dict[str, str]]:
    """Where the ID3v2 tag ends, and its own text fields (name and value)."""
    fields: dict[str, str] = {}
    if data[:3] != b"ID3" or len(data) < 10 or data[3] not in (2, 3, 4):
        return 0, fields
    version, flags, size = data[3], data[5], safe_int(data[6:10])
    end = min(len(data), 10 + size + (10 if version == 4 and flags & 0x10 else 0))
    body = data[10 : min(len(data), 10 + size)]
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    number = safe_int if version == 4 else lambda x: int.from_bytes(x, "big")
    at = 0
    if flags & 0x40 and version > 2:
        at = number(body[:4]) + (4 if version == 3 else 0)
    name, head = (3, 6) if version == 2 else (4, 10)
    while at + head <= len(body) and body[at] != 0:
        n = number(body[at + name : at + 2 * name])
        own = body[at + head : at + head + n]
        if version == 4 and body[at + 9] & 0x02:
            own = own.replace(b"\xff\x00", b"\xff")
        if version == 4 and body[at + 9] & 0x01:
            own = own[4:]
        if body[at : at + name] in (b"TXXX", b"TXX"):
            said = [x.lstrip("\ufeff") for x in tag_text(own)]
            fields[said[0]] = said[1] if len(said) > 1 else ""
        at += head + n
    return end, fields


def read_table(frame: bytes, start: int) -> tuple[int, int, bytes] | None:
    """Frame count, byte count (-1 where they are not told) and seek points of a variable-bitrate header; start is where side information ends."""
    if frame[start : start + 4] in (b"Xing", b"Info") and len(frame) >= start + 8:
        flags, at, told = struct.unpack(">I", frame[start + 4 : start + 8])[0], start + 8, []
        for bit in (1, 2):
            has = flags & bit and at + 4 <= len(frame)
            told.append(struct.unpack(">I", frame[at : at + 4])[0] if has else -1)
            at += 4 if flags & bit else 0
        return told[0], told[1], frame[at : at + 100] if flags & 4 else b""
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        total, n, entries, scale, width = struct.unpack(">IIHHH", frame[46:60])
        table = frame[62 : 62 + entries * width]
        steps = [int.from_bytes(table[i : i + width], "big") * scale for i in range(0, len(table), width)] if width else []
        return n, total, bytes(min(255, sum(steps[: len(steps) * p // 100]) * 256 // max(total, 1)) for p in range(100)) if steps else b""
    return None


def decode(data: bytes) -> dict:
    """Payload, tag fields, duration, frame offsets, checksum failures, skipped bytes and the greatest error of a seek point (in 256ths of the file, -1 without any) of a file."""
    begin, fields = read_tag(data)
    end = len(data) - 128 if len(data) >= 128 and data[-128:-125] == b"TAG" else len(data)
    parts: list[bytes] = []
    offsets: list[int] = []
    table: tuple[int, int, bytes] | None = None
    rate = bad = skipped = samples = 0
    stream, at = None, begin
    audio = -1
    while at < end:
        head = parse_header(data[at : at + 4])
        if head is not None and at + head.size <= end and head.size > 4:
            after = at + head.size
            following = parse_header(data[after : after + 4])
            if head.stream == stream or after == end or following is not None and following.stream == head.stream:
                body = at + 4 + 2 * head.protected
                start = body + head.side
                if head.protected and head.side and crc16(data[at + 2 : at + 4] + data[body:start]) != data[at + 4] << 8 | data[at + 5]:
                    bad += 1
                    stream = None
                    at += 1
                    skipped += 1
                    continue
                audio = at if audio < 0 else audio
                if table is None and not offsets and (table := read_table(data[at:after], start - at)) is not None:
                    pass
                else:
                    offsets.append(at)
                    parts.append(data[start:after])
                    samples += head.samples
                rate, stream = head.rate, head.stream
                at = after
                continue
        stream = None
        nxt = data.find(b"\xff", at + 1, end)
        nxt = end if nxt < 0 else nxt
        skipped += nxt - at
        at = nxt
    payload = b"".join(parts)
    if (n := fields.get("payload", "")).isascii() and n.isdigit():
        payload = payload[: int(n)]
    off = -1
    if table is not None and len(table[2]) == 100 and offsets and table[1] > 0:
        off = max(abs(table[2][p] - min(255, (offsets[len(offsets) * p // 100] - audio) * 256 // table[1])) for p in range(100))
    return {"payload": payload, "fields": fields, "rate": rate, "frames": len(offsets), "samples": samples, "offsets": offsets, "table": table, "bad": bad, "skipped": skipped, "seek_error": off}


def pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % 64 if data else 64)


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the column media: every whole text as an audio file."""

    def kernel(text: str) -> tuple:
        data = text.encode("utf-8", "surrogatepass")
        return len(data), encode(pad(data))

    return map_texts(docs, lambda: kernel, "n_bytes long, media binary")


def features(files: DataFrame) -> DataFrame:
    """The files' own properties and their payloads' digests, from the stored bytes alone; seek_offsets has the byte offset of every frame."""

    def kernel(data: bytes) -> tuple:
        x = decode(data)
        payload, rate = x["payload"], x["rate"] or RATES[0]
        told = x["table"][0] if x["table"] else -1
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), x["frames"], x["samples"], rate, told, x["bad"], x["skipped"], x["seek_error"], x["offsets"])

    fields = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, n_samples long, sample_rate long, table_frames long, bad_frames long, skipped_bytes long, seek_error long, seek_offsets array<long>"
    return map_texts(files, lambda: kernel, fields, column="media", keep=("doc_id", "n_bytes"))


def feature_text() -> "F.Column":
    """The features as one string: frames, samples at the rate, checksum failures, error of the seek points, frames' offsets and their hash."""
    seek = F.concat_ws(",", F.col("seek_offsets").cast("array<string>"))
    return F.concat_ws(":", F.col("n_frames").cast("string"), F.concat_ws("/", F.col("n_samples").cast("string"), F.col("sample_rate").cast("string")), F.col("bad_frames").cast("string"), F.col("seek_error").cast("string"), F.size("seek_offsets").cast("string"), F.crc32(seek.cast("binary")).cast("string"))
