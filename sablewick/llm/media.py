"""Media columns: MPEG audio.

A payload is stored in the main-data bytes of MPEG-1 Layer III frames: an ID3v2
tag, a variable-bitrate (Xing) frame with its table of contents, then protected
frames, each with a CRC-16 over its header and side information.  Side
information is all zero, so a player decodes silence and skips the bytes.

Reading is done from the stored bytes alone: parse tags, resynchronise on a frame
header that a second header confirms, parse the variable-bitrate table, verify
each frame's checksum, and note the exact duration and every frame's offset.  All
versions (1, 2, 2.5) and layers (I, II, III) are read, at stated and free
bitrates; tables are Xing/Info or VBRI; tags are ID3v2.2 to 2.4 and ID3v1.
``audio_columns`` does this for a column of any audio bytes.

Defined results
---------------
* null text: the empty text; its payload is 64 zero bytes;
* empty and very long payloads: at least one data frame; a frame holds at most
  ``FRAME_ROOM`` payload bytes, so memory grows with one document only;
* damaged or foreign bytes: a header counts only if its frame's checksum holds
  or another header (or the end) follows; frames whose checksum fails are
  counted and left out, unknown bytes are skipped and counted; a checksum of
  Layer II, which covers a part of variable length, is counted as unchecked;
* null audio: no frames, duration 0;
* equal payloads give equal bytes, so repeated rows and ties agree;
* empty table: no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from sablewick.llm import common

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (version 1?, layer) and index, and Hz by index.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = (44100, 48000, 32000)
CRC_POLYNOMIAL, CRC_START = 0x8005, 0xFFFF
#: Bytes of Layer III side information by (version 1?, mono?).
SIDE_BYTES = {(True, False): 32, (True, True): 17, (False, False): 17, (False, True): 9}
VBRI_AT = 4 + 32
ID3V1_FIELDS = (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97), ("comment", 97, 127))

#: What is written: 32 kHz mono with protection.
WRITE_RATE, WRITE_MODE = 2, 3
HEAD = 4 + 2 + SIDE_BYTES[True, True]
BITRATES_KBPS = BITRATES[True, 3]
FRAME_ROOM = 144 * BITRATES_KBPS[-1] * 1000 // SAMPLE_RATES[WRITE_RATE] - HEAD
BLOCK = 64


@lru_cache(maxsize=4096)
def crc16(protected: bytes) -> int:
    """CRC-16 as frames carry it: most significant bit first."""
    crc = CRC_START
    for byte in protected:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ CRC_POLYNOMIAL if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def frame_header(bitrate_index: int) -> bytes:
    # sync, MPEG-1, Layer III, protected; bitrate, rate, no padding; mode
    return bytes((0xFF, 0xFA, bitrate_index << 4 | WRITE_RATE << 2, WRITE_MODE << 6))


@lru_cache(maxsize=32)
def frame_start(bitrate_index: int) -> bytes:
    """Header, checksum and side information of a written frame."""
    head, side = frame_header(bitrate_index), bytes(SIDE_BYTES[True, True])
    return head + struct.pack(">H", crc16(head[2:] + side)) + side


def frame_bytes(bitrate_index: int, rate: int) -> int:
    return 144 * BITRATES_KBPS[bitrate_index] * 1000 // rate


def synchsafe(n: int) -> bytes:
    return bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))


def unsynchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def pad(data: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of 64."""
    return data + bytes(-len(data) % BLOCK or (0 if data else BLOCK))


def store(payload: bytes) -> bytes:
    """An MPEG audio file whose frames carry ``payload``."""
    rate, top = SAMPLE_RATES[WRITE_RATE], len(BITRATES_KBPS) - 1
    full, rest = divmod(len(payload), FRAME_ROOM)
    body = [frame_start(top) + payload[i * FRAME_ROOM : (i + 1) * FRAME_ROOM] for i in range(full)]
    if rest or not full:
        index = next(i for i in range(1, top + 1) if frame_bytes(i, rate) - HEAD >= rest)
        room = frame_bytes(index, rate) - HEAD
        body.append(frame_start(index) + payload[full * FRAME_ROOM :] + bytes(room - rest))
    # The variable-bitrate frame: how many frames and bytes follow, and where each hundredth begins.
    index = next(i for i in range(1, top + 1) if frame_bytes(i, rate) >= HEAD + 4 + 4 + 4 + 4 + 100)
    own = frame_bytes(index, rate)
    total = own + sum(map(len, body))
    big = frame_bytes(top, rate)
    toc = bytes(min(255, (own + len(body) * k // 100 * big) * 256 // total) for k in range(100))
    table = frame_start(index) + b"Xing" + struct.pack(">III", 7, len(body), total) + toc
    table += bytes(own - len(table))
    private = b"payload\0" + struct.pack(">Q", len(payload))
    tag_frame = b"PRIV" + synchsafe(len(private)) + b"\0\0" + private
    return b"ID3\4\0\0" + synchsafe(len(tag_frame)) + tag_frame + table + b"".join(body)


@dataclass
class Audio:
    """What reading found."""

    payload: bytes = b""
    tags: dict[str, bytes] = field(default_factory=dict)
    version: float = 0
    layer: int = 0
    sample_rate: int = 0
    samples: int = 0
    offsets: list[int] = field(default_factory=list)  # of data frames
    bitrates: dict[int, int] = field(default_factory=dict)  # 0: free
    table: tuple[int, int, bytes] | None = None  # frames, bytes (-1: not told), contents
    bad_crc: int = 0
    unchecked: int = 0
    skipped: int = 0

    @property
    def seconds(self) -> float:
        return self.samples / self.sample_rate if self.sample_rate else 0.0


class Header(NamedTuple):
    size: int  # bytes of the frame, padding included; of a free bitrate the padding only
    rate: int
    protected: bool
    mono: bool
    kbps: int
    version: float
    layer: int
    samples: int
    covered: int  # bytes after the checksum that it covers; -1 if that depends on them
    kind: tuple  # what does not change within a stream


@lru_cache(maxsize=4096)
def parse_header(head: bytes) -> Header | None:
    """None for what is no frame header."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE0 != 0xE0:
        return None
    version, layer = {0: 2.5, 2: 2.0, 3: 1.0}.get(head[1] >> 3 & 3), 4 - (head[1] >> 1 & 3)
    index, r, padding, mode = head[2] >> 4, head[2] >> 2 & 3, head[2] >> 1 & 1, head[3] >> 6
    if version is None or layer == 4 or index == 15 or r == 3:
        return None
    first, mono = version == 1, mode == 3
    rate, kbps = int(SAMPLE_RATES[r] / {1.0: 1, 2.0: 2, 2.5: 4}[version]), BITRATES[first, layer][index]
    samples = 384 if layer == 1 else 576 if layer == 3 and not first else 1152
    slot = 4 if layer == 1 else 1  # a frame is a whole number of these
    size = (samples // 8 // slot * kbps * 1000 // rate + padding) * slot if kbps else padding * slot
    bound = 4 * ((head[3] >> 4 & 3) + 1) if mode == 1 else 32  # subbands that each channel has for itself
    covered = SIDE_BYTES[first, mono] if layer == 3 else (32 + (0 if mono else bound)) // 2 if layer == 1 else -1
    return Header(size, rate, not head[1] & 1, mono, kbps, version, layer, samples, covered, (version, layer, rate))


def sound(data: bytes, at: int, h: Header) -> bool:
    """Whether a frame's checksum holds; false for a frame without one that can be checked."""
    main = at + 6 + h.covered
    return h.protected and h.covered >= 0 and crc16(data[at + 2 : at + 4] + data[at + 6 : main]) == int.from_bytes(data[at + 4 : at + 6])


def free_size(data: bytes, at: int, h: Header, end: int) -> int:
    """Bytes, without padding, of the frames of a free-bitrate stream: the least distance to a like header that a third one, or the end, confirms."""
    to = at + 24
    while 0 <= (to := data.find(data[at : at + 2], to)) <= end - 4:
        other = parse_header(data[to : to + 4])
        if other and other.kind == h.kind and not other.kbps:
            size = to - at - h.size
            third = to + size + other.size
            if third == end or (last := parse_header(data[third : third + 4])) and last.kind == h.kind and not last.kbps:
                return size
        to += 1
    return 0


def follows(data: bytes, at: int, end: int, kind: tuple) -> bool:
    """Whether a frame that ends here is followed by a header of the same kind, or by nothing."""
    return at == end or ((h := parse_header(data[at : at + 4])) is not None and h.kind == kind)


def read_tags(data: bytes) -> tuple[dict[str, bytes], int]:
    """The frames of a leading ID3v2 tag and where it ends."""
    tags: dict[str, bytes] = {}
    if data[:3] != b"ID3" or len(data) < 10:
        return tags, 0
    version, flags, size = data[3], data[5], unsynchsafe(data[6:10])
    body, end = data[10 : 10 + size], 10 + size + (10 if flags & 16 else 0)
    if flags & 128 and version < 4:  # a zero was put after every FF
        body = body.replace(b"\xff\0", b"\xff")
    at = 0
    if flags & 64 and version == 3:  # an extended header
        at = 4 + int.from_bytes(body[:4])
    elif flags & 64 and version >= 4:
        at = unsynchsafe(body[:4]) if len(body) >= 4 else len(body)
    name, head = (3, 6) if version == 2 else (4, 10)
    while at + head <= len(body) and body[at]:
        size = body[at + name : at + (6 if version == 2 else 8)]
        n = unsynchsafe(size) if version >= 4 else int.from_bytes(size)
        value = body[at + head : at + head + n]
        if version >= 4 and (flags & 128 or body[at + 9] & 2):
            value = value.replace(b"\xff\0", b"\xff")
        tags[body[at : at + name].decode("latin-1")] = value
        at += head + n
    return tags, end


def read_table(data: bytes, at: int, h: Header, size: int) -> tuple[int, int, bytes] | None:
    """Frames, bytes and contents of a variable-bitrate table (Xing, Info or VBRI), each if told."""
    for begin in (at + 4 + 2 * h.protected + max(0, h.covered), at + 4 + max(0, h.covered)):
        if data[begin : begin + 4] in (b"Xing", b"Info") and begin + 8 <= at + size:
            flags, place, told = int.from_bytes(data[begin + 4 : begin + 8]), begin + 8, [-1, -1, b""]
            for k, length in enumerate((4, 4, 100)):
                if flags >> k & 1:
                    value = data[place : place + length]
                    told[k] = value if k == 2 else int.from_bytes(value)
                    place += length
            return tuple(told)
    begin = at + VBRI_AT
    if data[begin : begin + 4] == b"VBRI" and begin + 26 <= at + size:
        total, frames, entries, _, width = struct.unpack(">IIHHH", data[begin + 10 : begin + 24])
        return frames, total, data[begin + 26 : begin + 26 + entries * width]
    return None


def read(data: bytes) -> Audio:
    """Parse stored bytes; see the module's text."""
    out = Audio()
    out.tags, at = read_tags(data)
    end = len(data)
    if data[-128:-125] == b"TAG" and end >= 128:
        end -= 128
        out.tags |= {f"ID3v1.{name}": value for name, a, b in ID3V1_FIELDS if (value := data[end + a : end + b].rstrip(b"\0 "))}
    parts: list[bytes] = []
    first, kind, free = True, None, 0
    while at + 4 <= end:
        h = parse_header(data[at : at + 4])
        if h and kind and h.kind != kind:
            h = None  # one stream has one kind of frame
        if h and not h.kbps:
            free = free or free_size(data, at, h, end)
        size = 0 if h is None else h.size if h.kbps else free and free + h.size
        if not size or at + size > end or not (sound(data, at, h) or follows(data, at + size, end, h.kind)):
            new = data.find(b"\xff", at + 1, end)
            new = new if new >= 0 else end
            out.skipped += new - at
            at = new
            continue
        main = at + 4 + 2 * h.protected + max(0, h.covered)
        checked = h.protected and h.covered >= 0
        holds = not checked or sound(data, at, h)
        if first:
            first, kind = False, h.kind
            out.version, out.layer, out.sample_rate = h.version, h.layer, h.rate
            if h.layer == 3 and holds and (table := read_table(data, at, h, size)):
                out.table = table
                at += size
                continue
        if not holds:
            out.bad_crc += 1
        else:
            out.unchecked += h.protected and not checked
            out.offsets.append(at)
            out.samples += h.samples
            out.bitrates[h.kbps] = out.bitrates.get(h.kbps, 0) + 1
            parts.append(data[main : at + size])
        at += size
    if at < end:
        out.skipped += end - at
    whole = b"".join(parts)
    known = out.tags.get("PRIV", b"")
    n = struct.unpack(">Q", known[8:16])[0] if known[:8] == b"payload\0" and len(known) == 16 else len(whole)
    out.payload = whole[:n]
    return out


def feature(audio: Audio) -> str:
    """Exact duration, frame counts and a digest of the seek offsets, as text."""
    rates = ",".join(f"{k}x{v}" for k, v in sorted(audio.bitrates.items()))
    seek = zlib.crc32(struct.pack(f"<{len(audio.offsets)}Q", *audio.offsets))
    agrees = audio.table is not None and audio.table[0] == len(audio.offsets)
    return f"mpeg{audio.version:g}-layer{audio.layer};rate={audio.sample_rate};frames={len(audio.offsets)};samples={audio.samples};seconds={audio.seconds:.6f};kbps={rates};seek_crc32={seek};vbr_table={'ok' if agrees else 'off'};bad_crc={audio.bad_crc};skipped={audio.skipped}"


AUDIO_SCHEMA = (
    "doc_id long, version double, layer int, sample_rate int, samples long, seconds double, seek_offsets array<long>, bitrates map<int,long>, "
    "tags map<string,binary>, table_frames long, table_bytes long, bad_crc int, unchecked int, skipped long"
)
MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary, sample_rate int, samples long, seconds double, seek_offsets array<long>, bad_crc int, skipped long"
DIGEST_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_columns(docs: DataFrame) -> DataFrame:
    """Each text as an MPEG audio column with its exact duration and seek offsets."""
    from pyspark.sql.types import _parse_datatype_string

    def work(batch: pa.RecordBatch):
        for part in common.slices(batch.select(["doc_id", "text"]), "text", 4 << 20):
            out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "media", "sample_rate", "samples", "seconds", "seek_offsets", "bad_crc", "skipped")}
            for doc_id, text in zip(part.column(0).to_pylist(), common.texts_of(part.column(1))):
                raw = text.encode()
                media = store(pad(raw))
                a = read(media)
                for k, v in zip(out, (doc_id, len(raw), media, a.sample_rate, a.samples, a.seconds, a.offsets, a.bad_crc, a.skipped)):
                    out[k].append(v)
            yield out

    return common.map_batches(docs.select("doc_id", "text"), _parse_datatype_string(MEDIA_SCHEMA), work)


def media_digests(docs: DataFrame) -> DataFrame:
    """Digests of the stored form and of the payload read back from it."""
    from pyspark.sql.types import _parse_datatype_string

    def work(batch: pa.RecordBatch):
        for part in common.slices(batch.select(["doc_id", "text"]), "text", 4 << 20):
            out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for doc_id, text in zip(part.column(0).to_pylist(), common.texts_of(part.column(1))):
                raw = text.encode()
                media = store(pad(raw))
                a = read(media)
                p = a.payload
                for k, v in zip(out, (doc_id, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature(a))):
                    out[k].append(v)
            yield out

    return common.map_batches(docs.select("doc_id", "text"), _parse_datatype_string(DIGEST_SCHEMA), work)


def audio_columns(rows: DataFrame, audio: str = "audio") -> DataFrame:
    """For each row (of doc_id and a binary column) what reading its audio found: exact duration, seek offsets, tags, table, damage."""
    from pyspark.sql.types import _parse_datatype_string

    def work(batch: pa.RecordBatch):
        for part in common.slices(batch, 1, 4 << 20):
            found = [read(data or b"") for data in part.column(1).to_pylist()]
            out = {k: [getattr(a, k) for a in found] for k in ("layer", "sample_rate", "samples", "seconds", "bad_crc", "unchecked", "skipped")}
            out |= {"version": [float(a.version) for a in found], "seek_offsets": [a.offsets for a in found], "bitrates": [list(a.bitrates.items()) for a in found]}
            out |= {"tags": [list(a.tags.items()) for a in found], "table_frames": [a.table[0] if a.table else None for a in found]}
            yield out | {"doc_id": part.column(0), "table_bytes": [a.table[1] if a.table else None for a in found]}

    return common.map_batches(rows.select("doc_id", audio), _parse_datatype_string(AUDIO_SCHEMA), work)
