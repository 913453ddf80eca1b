"""Media columns: payloads stored as 8-bit sound samples, and signature sniffing over stored bytes.

`store_wave` lays a binary payload out as a RIFF/WAVE column (8-bit mono PCM) with Spark expressions.
`sniff` finds the magic bytes of known formats with one Aho-Corasick automaton, lets a validator for
each format confirm structure and lengths, corrects the declared type, and carves what is embedded.

Defined results: null bytes count as none; bytes that no validator confirms have the type
application/octet-stream, an empty payload and no carved items; repeated rows are judged alike, an empty
table gives no rows. Only `keep`, the bytes and the declared type are read, so that other columns can't clash.
Searches for what closes an item are shared by all magic bytes of a blob, so that long blobs take time in
proportion to their length.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Callable
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, field

UNIT = 576
UNKNOWN = "application/octet-stream"
RATE = 8000


class Found(NamedTuple):
    type: str
    start: int
    end: int


def _png(b: bytes, at: int) -> int:
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or first and (kind != b"IHDR" or n != 13):
            return 0
        if zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return 0
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return p
    return 0


def _riff(b: bytes, at: int) -> int:
    if at + 12 > len(b):
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b) or b[at + 8 : at + 12] not in (b"WAVE", b"WEBP", b"AVI "):
        return 0
    p, seen = at + 12, set()
    while p + 8 <= end:
        kind, n = struct.unpack_from("<4sI", b, p)
        if p + 8 + n > end:
            return 0
        seen.add(kind)
        p += 8 + n + n % 2
    wave = b[at + 8 : at + 12] == b"WAVE"
    return end if p in (end, end + 1) and (not wave or {b"fmt ", b"data"} <= seen) else 0


def _gif(b: bytes, at: int) -> int:
    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += 1 + b[p]
        return p + 1 if p < len(b) else 0

    if at + 13 > len(b):
        return 0
    p = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 128 else 0)
    while p < len(b):
        if b[p] == 0x3B:
            return p + 1
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 < len(b):
            p += 10 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 128 else 0)
            p = blocks(p + 1)
        else:
            return 0
        if not p:
            return 0
    return 0


def _jpeg(b: Blob, at: int) -> int:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind = b[p + 1]
        n = struct.unpack_from(">H", b, p + 2)[0]
        if n < 2 or p + 2 + n > len(b):
            return 0
        p += 2 + n
        if kind == 0xDA:  # entropy-coded data lasts to the end marker
            end = b.next(b"\xff\xd9", p)
            return end + 2 if end >= 0 else 0
    return 0


def _bmp(b: bytes, at: int) -> int:
    if at + 30 > len(b):
        return 0
    size, zero, offset, header = struct.unpack_from("<IIII", b, at + 2)
    planes = struct.unpack_from("<H", b, at + 26)[0]
    return at + size if zero == 0 and planes == 1 and header in (40, 52, 56, 108, 124) and 14 + header <= offset <= size and at + size <= len(b) else 0


class Blob(bytes):
    """Bytes that remember where something was last found: validators ask from ever later places, so that each byte is searched once."""

    def next(self, what: bytes, at: int) -> int:
        """Where `what` is found at or after `at`, or -1."""
        known = self.__dict__.setdefault("known", {})
        last = known.get(what, -2)
        if last == -2 or 0 <= last < at:
            last = known[what] = self.find(what, at)
        return last

    def zip_starts(self) -> dict[int, int]:
        """From where an archive must start, by the closing records that agree with their directories, to where it ends."""
        if "zips" not in self.__dict__:
            out: dict[int, int] = {}
            end = self.find(b"PK\x05\x06")
            while 0 <= end <= len(self) - 22:
                size, offset, note = struct.unpack_from("<IIH", self, end + 12)
                start = end - size - offset
                if start >= 0 and end + 22 + note <= len(self) and (not size or self.startswith(b"PK\x01\x02", start + offset)):
                    out.setdefault(start, end + 22 + note)
                end = self.find(b"PK\x05\x06", end + 1)
            self.__dict__["zips"] = out
        return self.__dict__["zips"]


def _pdf(b: Blob, at: int) -> int:
    table = b.next(b"startxref", at)
    end = b.next(b"%%EOF", table) if table >= 0 else -1
    return end + 5 if end >= 0 else 0


def _gzip(b: bytes, at: int) -> int:
    d = zlib.decompressobj(31)
    try:
        p = at
        while not d.eof and p < len(b):
            d.decompress(b[p : p + 65536])
            p += 65536
    except zlib.error:
        return 0
    return min(p, len(b)) - len(d.unused_data) if d.eof else 0


def _zip(b: Blob, at: int) -> int:
    return b.zip_starts().get(at, 0)


def _crc_table(bits: int, polynomial: int) -> list[int]:
    out = []
    for k in range(256):
        k <<= bits - 8
        for _ in range(8):
            k = (k << 1 ^ polynomial * (k >> bits - 1)) & (1 << bits) - 1
        out.append(k)
    return out


CRC8, CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)


def _frame_header(b: bytes, p: int) -> int:
    """The length of the FLAC frame header at p, or 0."""
    if p + 6 > len(b) or b[p] != 0xFF or b[p + 1] & 0xFE != 0xF8:
        return 0
    block, rate, first = b[p + 2] >> 4, b[p + 2] & 15, b[p + 4]
    if not block or rate == 15 or b[p + 3] >> 4 > 10 or b[p + 3] & 1:
        return 0
    more = 0 if first < 0x80 else next((k for k in range(1, 7) if not first << k + 1 & 0x80), 7)  # bytes after the number's first
    if more and (first < 0xC0 or more > 6):
        return 0
    n = 5 + more + {6: 1, 7: 2}.get(block, 0) + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    crc = 0
    for x in b[p : p + n]:
        crc = CRC8[crc ^ x]
    return n + 1 if p + n < len(b) and crc == b[p + n] else 0


def _flac(b: bytes, at: int) -> int:
    """Metadata blocks up to the last one, then frames: each header has its checksum, each frame ends where its own comes out even and a frame, or nothing like one, follows."""
    p, last = at + 4, False
    while not last:
        if p + 4 > len(b):
            return 0
        last, kind, n = b[p] > 127, b[p] & 127, int.from_bytes(b[p + 1 : p + 4], "big")
        if (kind == 0) != (p == at + 4) or kind == 0 and n != 34 or kind == 127 or p + 4 + n > len(b):
            return 0
        p += 4 + n
    ended = 0
    while head := _frame_header(b, p):
        crc, k, ended_here = 0, p, 0
        while k < len(b):  # to the next frame, or to the last place where the checksum comes out even
            crc = (crc << 8 & 0xFFFF) ^ CRC16[crc >> 8 ^ b[k]]
            k += 1
            if crc == 0 and k >= p + head + 2:
                ended_here = k
                if _frame_header(b, k):
                    break
        if not ended_here:
            return ended
        p = ended = ended_here
    return ended


#: Magic bytes, type and validator: the validator returns where the item ends, or 0. Fixed values of the formats.
FORMATS: list[tuple[bytes, str, Callable[[Blob, int], int]]] = [
    (b"RIFF", "audio/wav", _riff),
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"BM", "image/bmp", _bmp),
    (b"%PDF-", "application/pdf", _pdf),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"fLaC", "audio/flac", _flac),
]


def automaton() -> ahocorasick.Automaton:
    """Over latin-1 strings, so that a character is a byte."""
    made = ahocorasick.Automaton()
    for k, (magic, _, _) in enumerate(FORMATS):
        made.add_word(magic.decode("latin-1"), (k, len(magic)))
    made.make_automaton()
    return made


def find_media(b: bytes, made: ahocorasick.Automaton) -> list[Found]:
    """Every confirmed item, in order of its start; an item inside another one is listed too."""
    found, b = [], Blob(b)
    for last, (k, n) in made.iter(b.decode("latin-1")):
        if end := FORMATS[k][2](b, start := last - n + 1):
            kind = FORMATS[k][1]
            if kind == "audio/wav":
                kind = {b"WAVE": kind, b"WEBP": "image/webp"}.get(b[start + 8 : start + 12], "video/x-msvideo")
            found.append(Found(kind, start, end))
    return found


def wave_payload(b: bytes, at: int = 0) -> bytes:
    """The samples of the WAVE file that starts at `at`."""
    p, end = at + 12, at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    while p + 8 <= end:
        kind, n = struct.unpack_from("<4sI", b, p)
        if kind == b"data":
            return b[p + 8 : p + 8 + n]
        p += 8 + n + n % 2
    return b""


def wave_features(payload: bytes) -> str:
    """Samples, seconds, mean, root mean square about it, entropy in bits and crossings of the middle."""
    x = np.frombuffer(payload, np.uint8)
    if not x.size:
        return "samples=0"
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / x.size
    mean = float(np.dot(counts, np.arange(256)) / x.size)
    power = float(np.dot(counts, (np.arange(256) - mean) ** 2) / x.size)
    high = x >= 128
    return f"samples={x.size};seconds={x.size / RATE:.4f};mean={mean:.4f};rms={math.sqrt(power):.4f};entropy={-float((p * np.log2(p)).sum()):.4f};crossings={int(np.count_nonzero(high[1:] != high[:-1]))}"


def padded(payload: Column, unit: int = UNIT) -> Column:
    """payload followed by bytes 255 up to a positive multiple of unit."""
    n = F.octet_length(payload)
    size = F.greatest(F.lit(1), F.ceil(n / unit)) * unit
    return F.concat(payload, F.unhex(F.repeat(F.lit("FF"), (size - n).cast("int"))))


def _little(n: Column) -> Column:
    """n as four bytes, lowest first."""
    h = F.lpad(F.hex(n), 8, "0")
    return F.unhex(F.concat(*(F.substring(h, k, 2) for k in (7, 5, 3, 1))))


def store_wave(payload: Column) -> Column:
    """payload (of an even length) as a RIFF/WAVE file of 8-bit mono samples."""
    n = F.octet_length(payload)
    form = struct.pack("<4s4sIHHIIHH", b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    return F.concat(F.lit(b"RIFF"), _little(n + 36), F.lit(form + b"data"), _little(n), payload)


RESULT = [
    field("media_type", T.StringType()),
    field("corrected", T.BooleanType()),
    field("media_bytes", T.LongType()),
    field("media_sha256", T.StringType()),
    field("payload_bytes", T.LongType()),
    field("payload_sha256", T.StringType()),
    field("tail_crc32", T.LongType()),
    field("embedded", T.ArrayType(T.StructType([field("type", T.StringType()), field("start", T.LongType()), field("length", T.LongType())]))),
    field("feature", T.StringType()),
]


def sniff(df: DataFrame, media: str, declared: str, keep: list[str], carve: bool = False) -> DataFrame:
    """`keep` and, for each row, the confirmed type of its bytes, digests and features of the payload read back, and what is embedded.

    declared names a column of MIME types; corrected says whether the bytes show another type. With
    carve, `carved` holds the embedded items' bytes.
    """

    def start():
        made = automaton()

        def compute(blobs: pa.Array, types: pa.Array) -> list[pa.Array]:
            rows, carved = [], []
            for b, said in zip(blobs.to_pylist(), types.to_pylist(), strict=True):
                b = b or b""
                found = find_media(b, made)
                whole = next((x for x in found if x.start == 0 and x.end == len(b)), None)
                payload = wave_payload(b) if whole and whole.type == "audio/wav" else b if whole else b""
                inside = [x for x in found if x is not whole]
                kind = whole.type if whole else UNKNOWN
                feature = f"{kind};{wave_features(payload)};embedded={len(inside)}" + "".join(f";{x.type}@{x.start}+{x.end - x.start}" for x in inside)
                rows.append((kind, kind != said, len(b), hashlib.sha256(b).hexdigest(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), [{"type": x.type, "start": x.start, "length": x.end - x.start} for x in inside], feature))
                if carve:
                    carved.append([b[x.start : x.end] for x in inside])
            out = [pa.array(list(x), kind) for x, kind in zip(zip(*rows, strict=True), KINDS, strict=True)]
            return out + ([pa.array(carved, pa.list_(pa.binary()))] if carve else [])

        return compute

    extra = [field("carved", T.ArrayType(T.BinaryType()))] if carve else []
    return append_columns(df, [media, declared], keep, RESULT + extra, start)


KINDS = [pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64())])), pa.string()]
