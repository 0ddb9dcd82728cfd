"""MPEG audio as a media column: write, resynchronise, parse, verify, index.

A stream is an ID3v2 tag, an Xing frame (frame count, byte count, 100-point seek
table), then MPEG-1 Layer III frames at 32 kHz with CRC, of varying bitrate.  A
payload rides as ancillary bytes behind empty side information, which is lossless:
decoders play silence and skip it.  Each frame says how many bytes it carries.

The reader makes no use of the writer's knowledge.  It reads ID3v2.3 and 2.4 text
fields and the ID3v1 block at the end, mono and stereo frames (whose side information
differs in length), Xing and VBRI tables.  A header counts if its checksum holds, so
that a damaged place costs no good frame before it, or if another header, a tag or the
end follows the frame.  Each CRC is verified; the reader returns exact
duration, payload, seek offsets and what it had to skip.  Other layers and MPEG-2 are
not read: their frames are skipped bytes.

A null payload is empty; equal payloads give equal streams; damaged bytes are
reported, never raised; repeated rows and other columns stay.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from augury.llm.common import map_rows

# Fixed values of the format (MPEG-1 Layer III).
BITRATES = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)  # kbit/s, by header index
RATES = (44100, 48000, 32000)  # Hz, by header index
SAMPLES = 1152  # per frame
SIDE = 32  # bytes of side information, two channels
RATE_INDEX = 2  # 32 kHz: frames need no padding
UNIT = 64  # payloads are padded to a multiple of this
HEAD = 4 + 2 + SIDE  # header, CRC, side information


def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    """The format's checksum: polynomial x^16 + x^15 + x^2 + 1, high bit first."""
    for byte in data:
        crc = ((crc << 8) & 0xFFFF) ^ _CRC[(crc >> 8) ^ byte]
    return crc


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = ((c << 1) ^ 0x8005) & 0xFFFF if c & 0x8000 else c << 1
        out.append(c)
    return out


_CRC = _crc_table()


def _frame_head(bitrate_index: int) -> bytes:
    """Header with CRC and empty side information."""
    head = bytes([0xFF, 0xFA, bitrate_index << 4 | RATE_INDEX << 2, 0x00])
    return head + crc16(head[2:] + bytes(SIDE)).to_bytes(2, "big") + bytes(SIDE)


def _frame_size(bitrate_index: int, rate_index: int, padding: int) -> int:
    return 144_000 * BITRATES[bitrate_index] // RATES[rate_index] + padding


_HEADS = {i: _frame_head(i) for i in range(1, 15)}
_ROOM = {i: _frame_size(i, RATE_INDEX, 0) - HEAD - 2 for i in range(1, 15)}


def padded(payload: bytes) -> bytes:
    """Zero bytes appended up to a positive multiple of 64."""
    return payload + bytes(-len(payload) % UNIT or (0 if payload else UNIT))


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _id3(fields: dict[str, str]) -> bytes:
    body = b""
    for name, value in fields.items():
        text = b"\x03" + name.encode() + b"\0" + value.encode()
        body += b"TXXX" + _syncsafe(len(text)) + b"\0\0" + text
    return b"ID3\x04\0\0" + _syncsafe(len(body)) + body


def encode(payload: bytes, n_bytes: int) -> bytes:
    """A stream that carries ``payload``; the tag keeps n_bytes, its length before padding."""
    frames, at = [], 0
    while at < len(payload) or not frames:
        part = payload[at : at + _ROOM[14]]
        i = next(k for k in range(1, 15) if _ROOM[k] >= len(part))
        frames.append(_HEADS[i] + len(part).to_bytes(2, "big") + part + bytes(_ROOM[i] - len(part)))
        at += len(part)
    info_size = _frame_size(9, RATE_INDEX, 0)  # 128 kbit/s
    total = info_size + sum(map(len, frames))
    starts, place = [], info_size
    for f in frames:
        starts.append(place)
        place += len(f)
    seek = bytes(min(255, starts[min(len(frames) - 1, k * len(frames) // 100)] * 256 // total) for k in range(100))
    info = _HEADS[9] + b"Xing" + struct.pack(">III", 7, len(frames), total) + seek
    return _id3({"n_bytes": str(n_bytes)}) + info + bytes(info_size - len(info)) + b"".join(frames)


@dataclass
class Stream:
    payload: bytes = b""
    tags: dict[str, str] = field(default_factory=dict)
    xing_frames: int | None = None
    xing_bytes: int | None = None
    toc: bytes = b""
    frames: int = 0
    samples: int = 0
    rate: int = 0
    bad_crc: int = 0
    vbri_frames: int | None = None
    vbri_bytes: int | None = None
    skipped: list[tuple[int, int]] = field(default_factory=list)
    #: (sample, byte offset) of every 50th frame
    seek: list[tuple[int, int]] = field(default_factory=list)

    @property
    def duration_us(self) -> int:
        return self.samples * 1_000_000 // self.rate if self.rate else 0


def _header(data: bytes, at: int) -> tuple[int, int, bool] | None:
    """(frame size, rate, protected) of a Layer III header at this place."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xFA:
        return None
    b, r = data[at + 2] >> 4, data[at + 2] >> 2 & 3
    if not 0 < b < 15 or r == 3:
        return None
    return _frame_size(b, r, data[at + 2] >> 1 & 1), RATES[r], not data[at + 1] & 1


def _side(data: bytes, at: int) -> int:
    """Bytes of side information: 17 in mono frames, else 32."""
    return 17 if data[at + 3] >> 6 == 3 else SIDE


def _crc_holds(data: bytes, at: int) -> bool:
    end = at + 6 + _side(data, at)
    return crc16(data[at + 2 : at + 4] + data[at + 6 : end]) == int.from_bytes(data[at + 4 : at + 6], "big")


def _confirmed(data: bytes, at: int) -> bool:
    h = _header(data, at)
    if h is None or at + h[0] > len(data):
        return False
    end = at + h[0]
    return end == len(data) or data[end : end + 3] in (b"TAG", b"ID3") or _header(data, end) is not None or h[2] and _crc_holds(data, at)


def _text(raw: bytes) -> str:
    """A text field: its first byte names the encoding."""
    kinds = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}
    return raw[1:].decode(kinds.get(raw[0] if raw else 0, "latin-1"), "replace")


def _syncsafe_value(raw: bytes) -> int:
    return sum((x & 0x7F) << s for x, s in zip(raw, (21, 14, 7, 0), strict=True))


def _tags(data: bytes) -> tuple[dict[str, str], int]:
    """Text fields of an ID3v2 tag at the beginning, and its size.  Field sizes are syncsafe from version 2.4 on."""
    if data[:3] != b"ID3" or len(data) < 10 or data[3] not in (3, 4):
        return {}, 10 + _syncsafe_value(data[6:10]) if data[:3] == b"ID3" and len(data) >= 10 else 0
    size = 10 + _syncsafe_value(data[6:10])
    out, at = {}, 10
    if data[5] & 0x40:  # extended header; its size counts itself in version 2.4
        at += _syncsafe_value(data[10:14]) if data[3] == 4 else 4 + int.from_bytes(data[10:14], "big")
    while at + 10 <= min(size, len(data)) and data[at : at + 4].strip(b"\0"):
        name, raw = data[at : at + 4].decode("latin-1"), data[at + 4 : at + 8]
        n = _syncsafe_value(raw) if data[3] == 4 else int.from_bytes(raw, "big")
        body = data[at + 10 : at + 10 + n]
        if name[:1] == "T":
            field_, _, value = _text(body).partition("\0") if name == "TXXX" else (name, "", _text(body))
            out[field_] = value.strip("\0")
        at += 10 + n
    return out, size


def _old_tag(data: bytes) -> dict[str, str]:
    """Fields of the ID3v1 block in the last 128 bytes."""
    raw = data[-128:]
    if len(raw) < 128 or raw[:3] != b"TAG":
        return {}
    spans = {"title": (3, 33), "artist": (33, 63), "album": (63, 93), "year": (93, 97)}
    return {k: v for k, (a, b) in spans.items() if (v := raw[a:b].split(b"\0")[0].decode("latin-1").strip())}


def decode(data: bytes | None) -> Stream:
    """Everything the stream's bytes say."""
    data = data or b""
    out = Stream()
    out.tags, at = _tags(data)
    out.tags = _old_tag(data) | out.tags
    parts: list[bytes] = []
    while at < len(data):
        if data[at : at + 3] == b"TAG":
            break
        if not _confirmed(data, at):
            begin = at
            at = data.find(b"\xff", at + 1)
            while 0 <= at and not _confirmed(data, at):
                at = data.find(b"\xff", at + 1)
            if at < 0:
                at = len(data) - 128 if data[-128:-125] == b"TAG" and len(data) - 128 > begin else len(data)
            out.skipped.append((begin, at))
            continue
        size, rate, protected = _header(data, at)  # type: ignore[misc]
        side, body = _side(data, at), data[at : at + size]
        p = 4 + 2 * protected + side
        if body[p : p + 4] in (b"Xing", b"Info"):
            p += 4
            flags = int.from_bytes(body[p : p + 4], "big")
            p += 4
            if flags & 1:
                out.xing_frames, p = int.from_bytes(body[p : p + 4], "big"), p + 4
            if flags & 2:
                out.xing_bytes, p = int.from_bytes(body[p : p + 4], "big"), p + 4
            if flags & 4:
                out.toc = body[p : p + 100]
        elif body[36:40] == b"VBRI":  # at this place whatever the mode
            out.vbri_bytes, out.vbri_frames = struct.unpack(">II", body[46:54])
            entries, _, width = struct.unpack(">HHH", body[54:60])
            out.toc = body[62 : 62 + entries * width]
        else:
            good = not protected or _crc_holds(data, at)
            out.bad_crc += not good
            if out.frames % 50 == 0:
                out.seek.append((out.samples, at))
            out.frames, out.samples, out.rate = out.frames + 1, out.samples + SAMPLES, rate
            if good and protected and side == SIDE:
                n = int.from_bytes(body[HEAD : HEAD + 2], "big")
                parts.append(body[HEAD + 2 : HEAD + 2 + n])
        at += size
    out.payload = b"".join(parts)
    return out


def store(docs: DataFrame) -> DataFrame:
    """doc_id and media: each text's UTF-8 bytes, padded, as a stream."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(c) -> Iterator[tuple]:
        for doc_id, text in zip(*c, strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            yield doc_id, encode(padded(raw), len(raw))

    return map_rows(docs, ["doc_id", "text"], f"doc_id {kind}, media binary", lambda: run)


def read(media: DataFrame) -> DataFrame:
    """What the stored streams hold, by parsing them.

    n_bytes is the tag's, payload is read back from the frames; duration_us is exact;
    seek_samples and seek_offsets index every 50th frame; gaps counts skipped runs.
    """
    kind = media.schema["doc_id"].dataType.simpleString()

    def run(c) -> Iterator[tuple]:
        for doc_id, data in zip(*c, strict=True):
            s = decode(data)
            p = s.payload
            n = s.tags.get("n_bytes", "")
            agree = s.xing_frames == s.frames and s.bad_crc == 0 and not s.skipped
            feature = f"frames={s.frames};duration_us={s.duration_us};xing={s.xing_frames};crc_errors={s.bad_crc};gaps={len(s.skipped)};toc={zlib.crc32(s.toc)};byte_sum={sum(p)}"
            yield (
                doc_id, int(n) if n.isdigit() else None, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(data or b""), hashlib.sha256(data or b"").hexdigest(),
                feature, s.duration_us, [x for x, _ in s.seek], [x for _, x in s.seek], agree,
            )

    return map_rows(
        media,
        ["doc_id", "media"],
        f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_us long, seek_samples array<long>, seek_offsets array<long>, verified boolean",
        lambda: run,
    )
