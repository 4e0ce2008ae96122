"""MPEG audio as a media column: writing payloads as frames, and probing streams.

The probe reads streams of MPEG 1, 2 and 2.5, layers I to III: ID3v2 and ID3v1
tags, Xing/Info and VBRI tables, checksums, exact durations and the offset of
every frame; it resynchronises after damage.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import prepare, stored, text_of

# Fixed values of the MPEG audio header (ISO/IEC 11172-3 and 13818-3).
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
KBITS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
VERSION_NAMES = {3: "1", 2: "2", 0: "2.5"}

#: Payloads are padded with zeros to a positive multiple of this.
BLOCK = 64


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        value = byte << 8
        for _ in range(8):
            value = ((value << 1) ^ 0x8005 if value & 0x8000 else value << 1) & 0xFFFF
        table.append(value)
    return table


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    """The checksum of a frame: polynomial 0x8005, from 0xFFFF."""
    value = 0xFFFF
    for byte in data:
        value = ((value << 8) & 0xFFFF) ^ _CRC[(value >> 8) ^ byte]
    return value


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    protected: bool
    kbits: int
    rate: int
    size: int
    samples: int
    mono: bool

    @property
    def side(self) -> int:
        """Bytes of the side information of layer III."""
        if self.version == 3:
            return 17 if self.mono else 32
        return 9 if self.mono else 17


_HEADERS: dict[bytes, Header | None] = {}


def header(raw: bytes) -> Header | None:
    """A frame header, or None if the four bytes are none (free format included)."""
    if raw not in _HEADERS:
        if len(_HEADERS) > 1 << 16:
            _HEADERS.clear()
        _HEADERS[raw] = _header(raw)
    return _HEADERS[raw]


def _header(raw: bytes) -> Header | None:
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3)
    at, rate_at, padding = raw[2] >> 4, raw[2] >> 2 & 3, raw[2] >> 1 & 1
    if version == 1 or layer == 4 or at in (0, 15) or rate_at == 3:
        return None
    kbits, rate = KBITS[1 if version == 3 else 2, layer][at], RATES[version][rate_at]
    if layer == 1:
        samples, size = 384, (12000 * kbits // rate + padding) * 4
    else:
        samples = 576 if layer == 3 and version != 3 else 1152
        size = samples // 8 * 1000 * kbits // rate + padding
    return Header(version, layer, not raw[1] & 1, kbits, rate, size, samples, raw[3] >> 6 == 3)


#: Bits of the allocation of each subband of layer II, by table.
ALLOCATION = {
    "a": (4,) * 11 + (3,) * 12 + (2,) * 4,
    "b": (4,) * 11 + (3,) * 12 + (2,) * 7,
    "c": (4,) * 2 + (3,) * 6,
    "d": (4,) * 2 + (3,) * 10,
    "low": (4,) * 4 + (3,) * 7 + (2,) * 19,
}


def allocation_of(h: Header) -> tuple[int, ...]:
    """Bits of the allocation of each subband, layers I and II."""
    if h.layer == 1:
        return (4,) * 32
    if h.version != 3:
        return ALLOCATION["low"]
    each = h.kbits if h.mono else h.kbits // 2
    if 56 <= each <= 80 or h.rate == 48000 and each >= 56:
        return ALLOCATION["a"]
    if each >= 96:
        return ALLOCATION["b"]
    return ALLOCATION["d" if h.rate == 32000 else "c"]


def checked_bits(data: bytes, at: int, h: Header) -> tuple[int, int]:
    """The bits after the checksum that it covers, as a number, and how many they are.

    Layer I: the allocation; layer II: allocation and the selection of scale
    factors of the subbands that have any; layer III: the side information.
    Subbands from the bound on share an allocation in joint stereo.
    """
    if h.layer == 3:
        return int.from_bytes(data[at + 6 : at + 6 + h.side]), 8 * h.side
    sizes = allocation_of(h)
    channels = 1 if h.mono else 2
    joint = data[at + 3] >> 6 == 1
    bound = min(len(sizes), 4 * (1 + (data[at + 3] >> 4 & 3))) if joint else len(sizes)
    body = data[at + 6 : at + h.size]
    whole, length, used = int.from_bytes(body), 8 * len(body), 0

    def take(n: int) -> int:
        nonlocal used
        used += n
        return whole >> max(0, length - used) & (1 << n) - 1

    scaled = 0
    for band, bits in enumerate(sizes):
        mine = [take(bits) for _ in range(channels if band < bound else 1)]
        scaled += sum(map(bool, mine)) if band < bound else channels * bool(mine[0])
    if h.layer == 2:
        take(2 * scaled)
    used = min(used, length)
    return whole >> length - used, used


def frame_crc(data: bytes, at: int, h: Header) -> int:
    """The checksum that a protected frame should carry."""
    bits, n = checked_bits(data, at, h)
    value = crc16(data[at + 2 : at + 4] + (bits >> n % 8).to_bytes(n // 8))
    for k in range(n % 8 - 1, -1, -1):
        top = value >> 15 ^ bits >> k & 1
        value = (value << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return value


def _synchsafe(raw: bytes) -> int:
    value = 0
    for byte in raw:
        value = value << 7 | byte & 0x7F
    return value


@dataclass
class Stream:
    """What a probe finds. Offsets and sizes are of audio frames, without a table frame."""

    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, object] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    checked: int = 0
    wrong: int = 0
    skipped: int = 0

    @property
    def samples(self) -> int:
        return sum(h.samples for h in self.headers)

    @property
    def micros(self) -> int:
        """The duration in microseconds, each frame at its own rate, rounded down,
        without the samples that the table says an encoder added."""
        by_rate: dict[int, int] = {}
        for h in self.headers:
            by_rate[h.rate] = by_rate.get(h.rate, 0) + h.samples
        added = int(self.table.get("delay", 0)) + int(self.table.get("padding", 0))
        if self.headers and added < by_rate[self.headers[0].rate]:
            by_rate[self.headers[0].rate] -= added
        return sum(n * 1_000_000 // r for r, n in by_rate.items())


def _id3v2(data: bytes, tags: dict[str, str]) -> int:
    """Read the tag at the start; return where it ends."""
    if len(data) < 10 or data[:3] != b"ID3":
        return 0
    major, flags, end = data[3], data[5], min(len(data), 10 + _synchsafe(data[6:10]))
    at = 10
    if flags & 0x40 and major == 3:  # an extended header; its size leaves itself out
        at += 4 + int.from_bytes(data[10:14])
    elif flags & 0x40 and major == 4:
        at += _synchsafe(data[10:14])
    while major in (3, 4) and at + 10 <= end and data[at : at + 4].isalnum():
        size = _synchsafe(data[at + 4 : at + 8]) if major == 4 else int.from_bytes(data[at + 4 : at + 8])
        name, body = data[at : at + 4].decode("latin-1"), data[at + 10 : min(end, at + 10 + size)]
        if name[0] == "T" and body:
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            text = body[1:].decode(code, "replace").rstrip("\0")
            if name == "TXXX" and "\0" in text:
                key, _, text = text.partition("\0")
                tags[f"TXXX:{key}"] = text
            else:
                tags[name] = text
        at += 10 + size
    return 10 + _synchsafe(data[6:10]) + (10 if major == 4 and flags & 0x10 else 0)  # and a footer


def _table(data: bytes, at: int, h: Header) -> dict[str, object]:
    """A Xing, Info or VBRI table in a frame, empty if it has none."""
    body = at + 4 + 2 * h.protected + h.side
    name = data[body : body + 4]
    if name in (b"Xing", b"Info") and body + 8 <= len(data):
        out: dict[str, object] = {"kind": name.decode()}
        flags, p = int.from_bytes(data[body + 4 : body + 8]), body + 8
        for bit, key in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[key], p = int.from_bytes(data[p : p + 4]), p + 4
        if flags & 4:
            out["toc"], p = data[p : p + 100], p + 100
        if flags & 8:
            out["quality"], p = int.from_bytes(data[p : p + 4]), p + 4
        if data[p : p + 4].isalnum() and p + 24 <= at + h.size:  # an encoder's own part: samples added at both ends
            both = int.from_bytes(data[p + 21 : p + 24])
            out["encoder"], out["delay"], out["padding"] = data[p : p + 9].decode("latin-1").rstrip("\0 "), both >> 12, both & 0xFFF
        return out
    if data[at + 36 : at + 40] == b"VBRI" and at + 54 <= len(data):
        size, frames = struct.unpack(">II", data[at + 46 : at + 54])
        out = {"kind": "VBRI", "frames": frames, "bytes": size}
        if at + 62 <= min(len(data), at + h.size):
            entries, scale, width, each = struct.unpack(">HHHH", data[at + 54 : at + 62])
            table = data[at + 62 : at + 62 + entries * width]
            if 1 <= width <= 4 and len(table) == entries * width:
                steps = [int.from_bytes(table[k : k + width]) * scale for k in range(0, len(table), width)]
                out |= {"toc": steps, "frames_per_entry": each}
        return out
    return {}


def probe(data: bytes) -> Stream:
    """Walk a stream. Any bytes are accepted; without a frame the duration is 0.

    Where no header stands, the probe goes on at the next header that another
    one follows at its frame's end (or that ends the stream there). The last 128
    bytes are an ID3v1 tag if they start as one, unless they belong to frames: a
    frame is cut where the tag would begin, and with them the frames end where
    the stream does.
    """
    tags: dict[str, str] = {}
    start, end = _id3v2(data, tags), len(data)
    if end < 128 or data[-128:-125] != b"TAG":
        return _walk(data, start, end, tags)[0]
    end -= 128
    out, last = _walk(data, start, end, tags)
    if last != end:
        whole, last = _walk(data, start, len(data), tags)
        if last == len(data):
            return whole
    for key, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93)):
        out.tags[f"v1:{key}"] = data[end + a : end + b].rstrip(b"\0 ").decode("latin-1")
    return out


def _walk(data: bytes, at: int, end: int, tags: dict[str, str]) -> tuple[Stream, int]:
    """The frames from ``at`` to ``end``, and where the last one ends."""
    out, last = Stream(tags), at
    sound: dict[bytes, bool] = {}
    synced, first = False, True
    while at + 4 <= end:
        h = header(data[at : at + 4])
        after = at + h.size if h else 0
        if h is None or after > end or not synced and after + 4 <= end and header(data[after : after + 4]) is None:
            following = data.find(b"\xff", at + 1, end)
            following = end if following < 0 else following
            out.skipped += following - at
            at, synced = following, False
            continue
        synced = True
        if h.protected:
            block = data[at + 2 : at + 6 + (h.side if h.layer == 3 else h.size - 6)]
            if block not in sound:
                if len(sound) > 1 << 10:
                    sound.clear()
                sound[block] = frame_crc(data, at, h) == int.from_bytes(block[2:4])
            out.checked += 1
            out.wrong += not sound[block]
        if first and h.layer == 3 and (table := _table(data, at, h)):
            out.table = table
        else:
            out.offsets.append(at)
            out.headers.append(h)
        first, at = False, after
        last = after
    out.skipped += max(0, end - at)
    return out, last


# Writing: MPEG 1 layer III, mono, 32 kHz, where every bit rate makes whole-byte
# frames without padding. A frame carries checksum and an all-zero side
# information (no main data: silence); the rest of it is ancillary data.
_SIDE = bytes(17)
_FRONT = 4 + 2 + len(_SIDE)


def _front(at: int) -> bytes:
    head = bytes([0xFF, 0xFA, at << 4 | 2 << 2, 0xC0])
    return head + crc16(head[2:] + _SIDE).to_bytes(2) + _SIDE


_FRONTS = {(h := header(_front(at)[:4])).size - _FRONT: _front(at) for at in range(1, 15)}
_ROOMS = sorted(_FRONTS)


def write(payload: bytes) -> bytes:
    """A stream whose frames' ancillary data hold the payload, with a tag of its
    length and a table of frames, bytes and seek points."""
    room = _ROOMS[-1]
    n = len(payload) // room
    whole = _FRONTS[room]
    frames = [whole + payload[i * room : (i + 1) * room] for i in range(n)]
    if rest := payload[n * room :]:
        small = next(r for r in _ROOMS if r >= len(rest))
        frames.append(_FRONTS[small] + rest + bytes(small - len(rest)))
    body = b"".join(frames)
    text = b"\x00payload_bytes\0" + str(len(payload)).encode()
    entry = b"TXXX" + len(text).to_bytes(4) + b"\0\0" + text
    tag = b"ID3\x03\0\0" + bytes(len(entry) >> s & 0x7F for s in (21, 14, 7, 0)) + entry
    size = next(r for r in _ROOMS if r >= 116) + _FRONT
    total = size + len(body)
    starts = [size + min(i, n) * (room + _FRONT) for i in range(len(frames))]
    toc = bytes(min(255, 256 * starts[i * len(frames) // 100] // total) if frames else 0 for i in range(100))
    table = b"Xing" + (7).to_bytes(4) + len(frames).to_bytes(4) + total.to_bytes(4) + toc
    return tag + (_FRONTS[size - _FRONT] + table).ljust(size, b"\0") + body


def read_payload(data: bytes, stream: Stream) -> bytes:
    """The payload of a stream of :func:`write`; ValueError unless checksums, table and length agree."""
    told = stream.tags.get("TXXX:payload_bytes", "")
    if not told.isdecimal():
        raise ValueError("no stored payload")
    size = int(told)
    if stream.wrong or stream.skipped or stream.table.get("frames") != len(stream.offsets):
        raise ValueError("damaged stream")
    payload = b"".join(data[at + _FRONT : at + h.size] for at, h in zip(stream.offsets, stream.headers, strict=True))
    if len(payload) < size:
        raise ValueError("short stream")
    return payload[:size]


def feature(stream: Stream) -> str:
    """Version, layer, rate, frames, samples, duration, checksums and seek points in one line."""
    if not stream.headers:
        return "no frames"
    h = stream.headers[0]
    seek = zlib.crc32(struct.pack(f"<{len(stream.offsets)}Q", *stream.offsets))
    return f"mpeg{VERSION_NAMES[h.version]} layer{h.layer} {h.rate}Hz frames={len(stream.headers)} samples={stream.samples} micros={stream.micros} crc={stream.checked - stream.wrong}/{stream.checked} seek={seek:08x}"


def padded(raw: bytes) -> bytes:
    return raw.ljust(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK), b"\0")


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every whole text, padded, as an MPEG stream.

    A null text counts as empty (64 zero bytes); a null doc_id stays; repeated
    rows stay; other columns are not read.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            media = pa.array([write(padded(t)) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), media], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_micros long, frame_offsets array<long>, error string"


def measured(data: bytes | None) -> tuple:
    """The features of one stored stream, from payload_bytes on, and what is wrong with it.

    Null media has nulls. A stream of other origin, or a damaged one, has the
    features of its frames and no payload; ``error`` says why.
    """
    if data is None:
        return (None,) * 8 + ("no media",)
    stream = probe(data)
    payload, error = None, None
    try:
        payload = read_payload(data, stream)
    except ValueError as wrong:
        error = str(wrong)
    told = (None, None, None) if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]))
    return *told, len(data), hashlib.sha256(data).hexdigest(), feature(stream), stream.micros, stream.offsets, error


def features(media: DataFrame) -> DataFrame:
    """What the stored bytes hold: payload, its digests, exact duration, frame offsets.

    Foreign, damaged and null media: see :func:`measured`. Repeated rows stay; an
    empty table gives an empty result; other columns are not read.
    """
    prepare(media.sparkSession)
    names = [x.split()[0] for x in _FEATURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measured(data) for data in batch.column(2).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, _FEATURES)


def store_and_probe(docs: DataFrame) -> DataFrame:
    """Write the media column to shared storage, read it back and probe it."""
    return features(stored(encode(docs), "media"))
