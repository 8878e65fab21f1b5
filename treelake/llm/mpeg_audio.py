"""MPEG audio media columns.

A payload is stored without loss as the main-data bytes of MPEG-1 Layer III frames (32 kHz, mono, protected by CRC-16) of varying
bitrate, behind an ID3v2 tag that has the payload's size and a first frame with a Xing table. The reader works on any byte string:
it reads tags (with unsynchronisation, extended headers and footers), looks for frame headers that agree with the next one, steps from
frame to frame and looks again where that fails, verifies checksums of Layer III (side information) and Layer I (bit allocation), reads
the Xing or VBRI table with its seek points, and gives the exact duration as samples over rate, and each frame's offset. Free-format
frames are measured by the distance of their headers.

Defined cases: a null or empty text is a payload of 64 bytes 0; equal texts have equal values; other columns are ignored; media with
no frame have duration 0 and no offsets; a frame cut off at the end is not counted; what Layer II's checksum covers depends on decoded
tables, so its protected frames count as crc_unchecked.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from treelake.llm.common import map_batches, rows_batch, texts

BITRATES = {  # kbit/s by (MPEG-1?, layer)
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SIDE = 17  # bytes of side information, MPEG-1 mono
DATA_AT = 4 + 2 + SIDE


def _table() -> list[int]:
    out = []
    for k in range(256):
        c = k << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


CRC = _table()


@lru_cache(4096)
def crc16(data: bytes) -> int:
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFFFF) ^ CRC[c >> 8 ^ b]
    return c


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    protected: bool
    bitrate: int
    rate: int
    mono: bool
    size: int
    samples: int
    bound: int = 32  # from this subband on joint stereo has one allocation for both channels

    @property
    def side(self) -> int:
        """Bytes behind the checksum that it covers: side information, or Layer I's bit allocation (of joint stereo at most); 0 where
        they aren't known without decoding."""
        if self.layer == 1:
            return 16 if self.mono else 16 + self.bound // 2
        if self.layer == 2:
            return 0
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)

    @property
    def data_at(self) -> int:
        return 4 + 2 * self.protected + self.side


@lru_cache(4096)
def header(b: bytes) -> Header | None:
    """The frame header in four bytes; None if they aren't one. Free-format frames aren't recognised."""
    if len(b) < 4 or b[0] != 0xFF or b[1] & 0xE0 != 0xE0:
        return None
    version, layer = b[1] >> 3 & 3, 4 - (b[1] >> 1 & 3)
    kbit, rate = b[2] >> 4, b[2] >> 2 & 3
    if version == 1 or layer == 4 or kbit in (0, 15) or rate == 3 or b[3] & 3 == 2:
        return None
    rate = RATES[version][rate]
    bitrate = BITRATES[version == 3, layer][kbit] * 1000
    pad = b[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    size = (12 * bitrate // rate + pad) * 4 if layer == 1 else samples // 8 * bitrate // rate + pad
    return Header(version, layer, not b[1] & 1, bitrate, rate, b[3] >> 6 == 3, size, samples, _bound(b[3]))


def _bound(b: int) -> int:
    return 4 * (b >> 4 & 3) + 4 if b >> 6 == 1 else 32


FREE = 8192  # bytes in which a free-format frame ends


def free_header(data: bytes, at: int, end: int, size: int | None = None) -> Header | None:
    """The header of a frame without a stated bitrate. size: that of a frame without padding, if it is known; else the next header of
    its kind tells it."""
    b = data[at : at + 4]
    if len(b) < 4 or b[0] != 0xFF or b[1] & 0xE0 != 0xE0 or b[2] >> 4:
        return None
    like = header(bytes((b[0], b[1], b[2] | 0x10, b[3])))
    if like is None:
        return None
    pad = (b[2] >> 1 & 1) * (4 if like.layer == 1 else 1)
    if size is None:
        k = data.find(b[:2], at + like.data_at, min(end, at + FREE))
        while k >= 0 and (k + 4 > end or (data[k + 2] ^ b[2]) & 0xFC or (data[k + 3] ^ b[3]) & 0xC0):
            k = data.find(b[:2], k + 1, min(end, at + FREE))
        if k < 0:
            return None
        size = k - at - pad
    bitrate = (size // 4 * like.rate // 12) if like.layer == 1 else size * like.rate * 8 // like.samples
    return Header(like.version, like.layer, like.protected, bitrate, like.rate, like.mono, size + pad, like.samples, like.bound)


def synchsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def from_synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


@dataclass
class Media:
    tags: dict[str, str] = field(default_factory=dict)
    vbr: dict = field(default_factory=dict)
    frames: list[tuple[int, Header]] = field(default_factory=list)  # place and header, the table's frame left out
    samples: int = 0
    rate: int = 0
    skipped: int = 0  # bytes that are in no frame or tag
    crc_failed: int = 0
    crc_checked: int = 0
    crc_unchecked: int = 0


def _tag(data: bytes, at: int, out: Media) -> int:
    """Reads the text frames of an ID3v2 tag of version 2.2 to 2.4; where the tag ends."""
    version, flags = data[at + 3], data[at + 5]
    end = at + 10 + from_synchsafe(data[at + 6 : at + 10])
    body = data[at + 10 : min(end, len(data))]
    if version == 4 and flags & 0x10:
        end += 10  # a footer
    if version < 4 and flags & 0x80:
        body = body.replace(b"\xff\0", b"\xff")
    k, name, head = 0, 3 if version == 2 else 4, 6 if version == 2 else 10
    if flags & 0x40 and version > 2 and len(body) >= 4:
        k = from_synchsafe(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4], "big")
    while k + head <= len(body) and body[k]:
        raw = body[k + name : k + name + (3 if version == 2 else 4)]
        n = from_synchsafe(raw) if version == 4 else int.from_bytes(raw, "big")
        if body[k : k + 1] == b"T" and n:
            one = body[k + head : k + head + n]
            if version == 4 and (body[k + 9] & 2 or flags & 0x80):
                one = one.replace(b"\xff\0", b"\xff")
            if version == 4 and body[k + 9] & 1:
                one = one[4:]  # its length before that
            if one:
                out.tags[body[k : k + name].decode("latin-1")] = one[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(one[0], "utf-8"), "replace")
        k += head + n
    return end


def _vbr(data: bytes, at: int, h: Header) -> dict:
    """A Xing, Info or VBRI table in a frame; nothing if there is none."""
    k = at + h.data_at
    if data[k : k + 4] in (b"Xing", b"Info"):
        flags, out, k0 = int.from_bytes(data[k + 4 : k + 8], "big"), {"kind": data[k : k + 4].decode()}, k + 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = int.from_bytes(data[k0 : k0 + 4], "big")
                k0 += 4
        if flags & 4:
            out["toc"] = list(data[k0 : k0 + 100])
        return out
    k = at + 36
    if data[k : k + 4] == b"VBRI":
        number = lambda a, b: int.from_bytes(data[k + a : k + b], "big")
        entries, scale, size = number(18, 20), number(20, 22), number(22, 24)
        points, place = [], at
        for i in range(entries if 0 < size <= 4 and k + 26 + entries * size <= len(data) else 0):
            place += number(26 + i * size, 26 + (i + 1) * size) * scale
            points.append(place)
        return {"kind": "VBRI", "bytes": number(10, 14), "frames": number(14, 18), "frames_per_point": number(24, 26), "points": points}
    return {}


def parse(data: bytes) -> Media:
    out, at, n, locked, free = Media(), 0, len(data), False, None
    end = n - 128 if n >= 128 and data[n - 128 : n - 125] == b"TAG" else n
    if end < n:
        out.tags["ID3v1"] = data[n - 125 : n - 95].decode("latin-1").rstrip("\0 ")
    first = True
    while at < end:
        if data[at : at + 3] == b"ID3" and at + 10 <= end:
            at, locked = _tag(data, at, out), False
            continue
        h = header(data[at : at + 4])
        if h is None and (h := free_header(data, at, end, free if locked else None)) is not None:
            free = h.size - (data[at + 2] >> 1 & 1) * (4 if h.layer == 1 else 1)
        if h is not None and not locked:  # a frame is believed if the next agrees with it, or the data end
            nxt = at + h.size
            other = header(data[nxt : nxt + 4]) or free_header(data, nxt, end, free)
            if nxt > end or nxt < end and data[nxt : nxt + 3] != b"ID3" and (other is None or (other.version, other.layer, other.rate) != (h.version, h.layer, h.rate)):
                h = None
        if h is None:
            jump = data.find(b"\xff", at + 1, end)
            out.skipped += (jump if jump > 0 else end) - at
            at, locked = (jump if jump > 0 else end), False
            continue
        if at + h.size > end:
            out.skipped += end - at
            break
        if h.protected and h.layer == 2:
            out.crc_unchecked += 1
        elif h.protected:
            out.crc_checked += 1
            covered = data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]
            out.crc_failed += crc16(covered) != int.from_bytes(data[at + 4 : at + 6], "big")
        table = _vbr(data, at, h) if first and h.layer == 3 else {}
        if table:
            out.vbr = table
        else:
            out.frames.append((at, h))
            out.samples += h.samples
            out.rate = out.rate or h.rate
        first, locked = False, True
        at += h.size
    return out


def _head(kbit: int) -> bytes:
    return bytes((0xFF, 0xFA, kbit << 4 | 2 << 2, 3 << 6))


#: Whole frame by bitrate's index: its bytes and how many of them are data.
FRAMES = [(k, 144 * b // 32, 144 * b // 32 - DATA_AT) for k, b in enumerate(BITRATES[True, 3]) if k]


def _frame(kbit: int, size: int, data: bytes) -> bytes:
    head, side = _head(kbit), bytes(SIDE)
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side + data + bytes(size - DATA_AT - len(data))


def store(payload: bytes) -> bytes:
    """The payload in frames: the largest, then the smallest that holds the rest."""
    frames, at, n = [], 0, len(payload)
    last, size, room = FRAMES[-1]
    while n - at > room:
        frames.append(_frame(last, size, payload[at : at + room]))
        at += room
    if at < n:
        k, size, room = next(f for f in FRAMES if f[2] >= n - at)
        frames.append(_frame(k, size, payload[at:]))
    text = b"\x03payload-bytes\0%d" % n
    tag = b"TXXX" + synchsafe(len(text)) + b"\0\0" + text
    tag = b"ID3\x04\0\0" + synchsafe(len(tag)) + tag
    k, size, _ = FRAMES[7]
    total, toc, place = size + sum(map(len, frames)), bytearray(100), [size]
    for f in frames:
        place.append(place[-1] + len(f))
    for i in range(100):
        toc[i] = min(255, place[i * len(frames) // 100] * 256 // total)
    table = b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + total.to_bytes(4, "big") + bytes(toc)
    return tag + _frame(k, size, table) + b"".join(frames)


def load(media: bytes, parsed: Media | None = None) -> bytes:
    """The stored payload; ValueError if checksums or sizes are wrong."""
    m = parsed or parse(media)
    body = b"".join([media[at + h.data_at : at + h.size] for at, h in m.frames])
    n = int(m.tags.get("TXXX", "payload-bytes\0-1").rpartition("\0")[2])
    if m.crc_failed or n < 0 or n > len(body) or m.vbr.get("frames") != len(m.frames):
        raise ValueError("these media don't hold a payload")
    return body[:n]


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8")
    return len(raw), raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def duration(m: Media) -> str:
    """Exact: samples/rate."""
    return f"{m.samples}/{m.rate or 1}"


def media_column(df: DataFrame) -> DataFrame:
    """doc_id and the stored media bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("media", pa.binary())])
    return map_batches(texts(df), lambda b: rows_batch(schema, [b.column(0), [store(payload_of(t.as_py())[1]) for t in b.column(1)]]), "doc_id long, media binary")


def probe(df: DataFrame, media_col: str = "media") -> DataFrame:
    """doc_id, exact duration, numbers of checksums, and frame seek offsets of a media column."""
    numbers = ("samples", "rate", "crc_checked", "crc_failed", "crc_unchecked", "skipped")
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in numbers], ("offsets", pa.list_(pa.int64()))])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m = [parse(x.as_py() or b"") for x in b.column(1)]
        return rows_batch(schema, [b.column(0), *[[getattr(x, c) for x in m] for c in numbers], [[at for at, _ in x.frames] for x in m]])

    return map_batches(df.select("doc_id", media_col), run, "doc_id long, " + ", ".join(f"{c} long" for c in numbers) + ", offsets array<long>")


def digests(df: DataFrame) -> DataFrame:
    """Stores each payload, reads the stored bytes back and returns digests of both and the media's features."""
    names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    schema = pa.schema(list(zip(names, kinds)))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc, t in zip(b.column(0).to_pylist(), b.column(1)):
            n, payload = payload_of(t.as_py())
            media = store(payload)
            m = parse(media)
            back = load(media, m)
            offsets = ",".join([str(at) for at, _ in m.frames])
            feature = f"duration={duration(m)};frames={len(m.frames)};crc={m.crc_checked - m.crc_failed}/{m.crc_checked};seek={offsets}"
            out.append((doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        return rows_batch(schema, list(zip(*out)))

    return map_batches(texts(df), run, ", ".join(f"{n} {'string' if k == pa.string() else 'long'}" for n, k in zip(names, kinds)))
