"""Signature sniffing of media columns.

One pass of an Aho-Corasick automaton over a column's bytes finds every place where a magic
number stands; a validator for that format then walks the structure (chunk lengths and
checksums, box and block sizes, end markers) and gives the item's exact length or rejects
it. What starts at offset 0 corrects the declared type; valid items elsewhere are carved
out as embedded media.

Formats: PNG, JPEG, GIF, BMP, WebP, WAV, AIFF, FLAC, Ogg, MP4, PDF, ZIP, gzip.

``payload_png`` stores arbitrary bytes losslessly as samples of an 8-bit grey PNG, and
``png_payload`` reads them back; the registered query sends texts through both.

Edge cases: null content is empty; empty or unknown content has type null and no items; an
item that is cut short is not valid; items inside another valid item are not carved again;
repeated rows give equal results; an empty table gives an empty result. Added columns
replace input columns of the same name.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTH = 192
_PNG = b"\x89PNG\r\n\x1a\n"


# Validators: (data, start) -> end of the valid item, or -1.


def _png(d: bytes, s: int) -> int:
    at, first = s + 8, True
    while at + 12 <= len(d):
        n, kind = struct.unpack_from(">I4s", d, at)
        end = at + 12 + n
        if n > 0x7FFFFFFF or end > len(d) or first != (kind == b"IHDR"):
            return -1
        if zlib.crc32(memoryview(d)[at + 4 : end - 4]) != struct.unpack_from(">I", d, end - 4)[0]:
            return -1
        if kind == b"IEND":
            return end
        at, first = end, False
    return -1


def _jpeg(d: bytes, s: int) -> int:
    at, frame = s + 2, False
    while at + 4 <= len(d) and d[at] == 0xFF:
        mark = d[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        if mark == 0xD9:
            return at + 2 if frame else -1
        n = struct.unpack_from(">H", d, at + 2)[0]
        if n < 2 or mark in (0x00, 0x01) or 0xD0 <= mark <= 0xD8:
            return -1
        frame |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        at += 2 + n
        if mark == 0xDA:
            # Entropy-coded data ends at the next marker that is neither stuffing nor a restart.
            m = _JPEG_MARK.search(d, at)
            if not m:
                return -1
            at = m.start()
    return at + 2 if frame and d[at : at + 2] == b"\xff\xd9" else -1


_JPEG_MARK = re.compile(rb"\xff[\x01-\xcf\xd8-\xfe]")


def _gif(d: bytes, s: int) -> int:
    if s + 13 > len(d):
        return -1
    at = s + 13 + (3 << (d[s + 10] & 7) + 1 if d[s + 10] & 0x80 else 0)
    images = 0

    def blocks(at: int) -> int:
        while at < len(d) and d[at]:
            at += d[at] + 1
        return at + 1

    while at < len(d):
        if d[at] == 0x3B:
            return at + 1 if images else -1
        if d[at] == 0x21:
            at = blocks(at + 2)
        elif d[at] == 0x2C and at + 11 <= len(d):
            at = blocks(at + 11 + (3 << (d[at + 9] & 7) + 1 if d[at + 9] & 0x80 else 0))
            images += 1
        else:
            return -1
    return -1


def _bmp(d: bytes, s: int) -> int:
    if s + 54 > len(d):
        return -1
    size, _, offset, header, width, height, planes, depth = struct.unpack_from("<IIIIiiHH", d, s + 2)
    rows = (width * depth + 31) // 32 * 4 * abs(height)
    return s + size if header >= 40 and planes == 1 and depth in (1, 4, 8, 16, 24, 32) and width > 0 and 54 <= offset and offset + rows <= size and s + size <= len(d) else -1


def _riff(d: bytes, s: int) -> int:
    size = struct.unpack_from("<I", d, s + 4)[0] if s + 12 <= len(d) else 0
    end, at, kinds = s + 8 + size, s + 12, set()
    if size < 4 or end > len(d):
        return -1
    while at + 8 <= end:
        kind, n = struct.unpack_from("<4sI", d, at)
        kinds.add(kind)
        at += 8 + n + n % 2
    whole = at == end or at == end + 1
    if d[s + 8 : s + 12] == b"WAVE":
        return end if whole and {b"fmt ", b"data"} <= kinds else -1
    return end if whole and kinds & {b"VP8 ", b"VP8L", b"VP8X"} else -1


def _aiff(d: bytes, s: int) -> int:
    if s + 12 > len(d) or d[s + 8 : s + 12] not in (b"AIFF", b"AIFC"):
        return -1
    end, at, kinds = s + 8 + struct.unpack_from(">I", d, s + 4)[0], s + 12, set()
    while at + 8 <= end <= len(d):
        kind, n = struct.unpack_from(">4sI", d, at)
        kinds.add(kind)
        at += 8 + n + n % 2
    return end if at == end and b"COMM" in kinds else -1


def _flac(d: bytes, s: int) -> int:
    """To the end of the data: frames don't tell their length."""
    at, last, first = s + 4, False, True
    while not last:
        if at + 4 > len(d):
            return -1
        last, kind, n = bool(d[at] & 0x80), d[at] & 0x7F, int.from_bytes(d[at + 1 : at + 4], "big")
        if first and (kind != 0 or n != 34):
            return -1
        at, first = at + 4 + n, False
    return len(d) if at <= len(d) and (at == len(d) or d[at] == 0xFF) else -1


def _ogg(d: bytes, s: int) -> int:
    at, final = s, False
    while d[at : at + 4] == b"OggS" and at + 27 <= len(d):
        n = d[at + 26]
        if d[at + 4] or at + 27 + n > len(d):
            return -1
        final = bool(d[at + 5] & 4)
        at += 27 + n + sum(d[at + 27 : at + 27 + n])
        if at > len(d):
            return -1
        if final:
            return at
    return -1


#: Boxes that stand outside others; only these are believed to reach to the end of the data.
_MP4_OUTER = frozenset(b"pdin moov moof mfra mdat imda free skip udta meta uuid wide pnot styp sidx ssix prft emsg".split())


def _mp4(d: bytes, s: int) -> int:
    """The magic stands four bytes into the first box."""
    at, kinds = s - 4, set()
    if at < 0:
        return -1
    while at + 8 <= len(d):
        n, kind = struct.unpack_from(">I4s", d, at)
        least = 8
        if n == 1 and at + 16 <= len(d):
            n, least = struct.unpack_from(">Q", d, at + 8)[0], 16
        elif n == 0 and kind in _MP4_OUTER:
            n = len(d) - at
        if n < least or at + n > len(d) or not kind.isalnum():
            break
        kinds.add(kind)
        at += n
    return at if {b"ftyp", b"moov"} <= kinds else -1


_PDF_MARK = re.compile(rb"%PDF-|%%EOF|startxref(?:\s{1,9}(\d{1,18}))?|xref|(?<!end)obj")
_PDF_OBJECT = re.compile(rb"(?<!\d)\d{1,10}\s{1,9}\d{1,10}\s{1,9}$")
_PDF_LENGTH = re.compile(rb"/L\s{1,9}(\d{1,18})")


@lru_cache(maxsize=1)
def _pdf_marks(d: bytes) -> tuple[list[int], list[int], dict[int, int]]:
    """(headers, ends that follow a startxref, the last end that points back to each header).

    An end points to the cross-reference table or stream before it by an offset from its
    file's header, which tells its file even when that holds other files.
    """
    headers, ends, owned = [], [], {}
    table = stream = -1
    offset: int | None = None
    ready = False
    for m in _PDF_MARK.finditer(d):
        kind, at = m[0], m.start()
        if kind == b"%PDF-":
            headers.append(at)
            ready = False
        elif kind == b"xref":
            table = at
        elif kind == b"obj":
            stream = at
        elif kind != b"%%EOF":
            ready, offset = True, int(m[1]) if m[1] else None
        elif ready:
            ends.append(at + 5)
            ready = False
            if offset is not None:
                number = _PDF_OBJECT.search(d[max(stream - 40, 0) : stream]) if stream >= 0 else None
                for start in (table - offset, stream - len(number[0]) - offset if number else -1):
                    if start >= 0 and d.startswith(b"%PDF-", start):
                        owned[start] = at + 5
    return headers, ends, owned


def _pdf(d: bytes, s: int) -> int:
    """To the last end of the file: linearized and updated files have several."""
    headers, ends, owned = _pdf_marks(bytes(d))

    def last_before_next_header(at: int) -> int:
        follows = bisect_right(headers, at)
        n = bisect_right(ends, headers[follows] if follows < len(headers) else len(d))
        return ends[n - 1] if n and ends[n - 1] > at else -1

    end = max(last_before_next_header(s), owned.get(s, -1))
    head = d[s : s + 1024]
    if b"/Linearized" in head and (stated := _PDF_LENGTH.search(head)) and (size := int(stated[1])) <= len(d) - s:
        if (last := d.rfind(b"%%EOF", s + max(size - 32, 0), s + size)) >= 0:
            end = max(end, last + 5)
    return max(end, last_before_next_header(end)) if end >= 0 else -1


@lru_cache(maxsize=1)
def _zip_ends(d: bytes) -> dict[int, int]:
    """Where archives start, by the offsets in their end records -> where the first such record ends."""
    found: dict[int, int] = {}
    at = d.find(b"PK\x05\x06")
    while 0 <= at <= len(d) - 22:
        size, offset, note = struct.unpack_from("<IIH", d, at + 12)
        start = at - size - offset
        if start >= 0 and d.startswith(b"PK\x01\x02", start + offset) and at + 22 + note <= len(d):
            found.setdefault(start, at + 22 + note)
        at = d.find(b"PK\x05\x06", at + 1)
    return found


def _zip(d: bytes, s: int) -> int:
    return _zip_ends(bytes(d)).get(s, -1)


def _gzip(d: bytes, s: int) -> int:
    if s + 18 > len(d) or d[s + 3] & 0xE0:
        return -1
    inflate = zlib.decompressobj(31)
    try:
        at = s
        while at < len(d) and not inflate.eof:
            inflate.decompress(d[at : at + 65536])
            at += 65536
    except zlib.error:
        return -1
    return min(at, len(d)) - len(inflate.unused_data) if inflate.eof else -1


#: Magic bytes, media type, how far the magic stands behind the start, validator.
FORMATS: list[tuple[bytes, str, int, Callable[[bytes, int], int]]] = [
    (_PNG, "image/png", 0, _png),
    (b"\xff\xd8\xff", "image/jpeg", 0, _jpeg),
    (b"GIF87a", "image/gif", 0, _gif),
    (b"GIF89a", "image/gif", 0, _gif),
    (b"BM", "image/bmp", 0, _bmp),
    (b"RIFF", "RIFF", 0, _riff),
    (b"FORM", "audio/aiff", 0, _aiff),
    (b"fLaC", "audio/flac", 0, _flac),
    (b"OggS", "audio/ogg", 0, _ogg),
    (b"ftyp", "video/mp4", 4, _mp4),
    (b"%PDF-", "application/pdf", 0, _pdf),
    (b"PK\x03\x04", "application/zip", 0, _zip),
    (b"\x1f\x8b\x08", "application/gzip", 0, _gzip),
]


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for n, (magic, *_) in enumerate(FORMATS):
        found.add_word(magic.decode("latin-1"), n)
    found.make_automaton()
    return found


def sniff(data: bytes) -> list[tuple[str, int, int]]:
    """(media type, offset, length) of the valid items, outermost only, in order."""
    items, past = [], 0
    # The library searches text; Latin-1 is a character for each byte.
    for last, n in _automaton().iter(data.decode("latin-1")):
        magic, kind, back, valid = FORMATS[n]
        at = last - len(magic) + 1
        if at - back < past:
            continue
        end = valid(data, at)
        if end > 0:
            if kind == "RIFF":
                kind = "audio/wav" if data[at + 8 : at + 12] == b"WAVE" else "image/webp"
            items.append((kind, at - back, end - at + back))
            past = end
    return items


def payload_png(payload: bytes) -> bytes:
    """Bytes, a positive multiple of WIDTH, as rows of an 8-bit grey PNG."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    plain = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter type 0 before each row
    plain[:, 1:] = rows

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(plain.tobytes(), 1)) + chunk(b"IEND", b"")


def png_payload(data: bytes) -> tuple[bytes, int, int]:
    """(samples, width, height) of an unfiltered 8-bit grey PNG."""
    at, packed, width, height = 8, [], 0, 0
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack_from(">IIBB", body)
            if (depth, colour) != (8, 0):
                raise ValueError("not 8-bit grey")
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes(), width, height


def pad_payload(text: bytes, unit: int = WIDTH) -> bytes:
    """Bytes 32 appended up to a positive multiple of the unit."""
    return text + b" " * ((-len(text)) % unit if text else unit)


SNIFFED = "struct<media_type:string, corrected:boolean, length:long, embedded:array<struct<media_type:string, offset:long, length:long>>>"


def sniff_column(content: Column, declared: Column) -> Column:
    """What stands at offset 0, whether that corrects the declared type, and embedded items."""

    @F.arrow_udf(SNIFFED)
    def sniffed(contents: pa.Array, types: pa.Array) -> pa.Array:
        out = []
        for data, said in zip(contents, types.to_pylist(), strict=True):
            items = sniff(data.as_py() or b"")
            first = items[0] if items and items[0][1] == 0 else None
            rest = [{"media_type": k, "offset": a, "length": n} for k, a, n in items[first is not None :]]
            out.append({"media_type": first and first[0], "corrected": bool(first) and first[0] != said, "length": first[2] if first else 0, "embedded": rest})
        return pa.array(out, pa.struct([("media_type", pa.string()), ("corrected", pa.bool_()), ("length", pa.int64()), ("embedded", pa.list_(pa.struct([("media_type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])))]))

    return sniffed(content, declared)


def store_column(text: Column) -> Column:
    """The padded UTF-8 bytes of each text as a PNG."""

    @F.arrow_udf("binary")
    def stored(texts: pa.Array) -> pa.Array:
        return pa.array([payload_png(pad_payload(t.as_py().encode("utf-8", "surrogatepass"))) for t in texts], pa.binary())

    return stored(text)


READ_BACK = "struct<payload_bytes:long, payload_sha256:string, tail_crc32:long, media_bytes:long, media_sha256:string, feature:string>"


def read_back_column(content: Column, media_type: Column, length: Column) -> Column:
    """Digests and features of the samples of what was sniffed at offset 0."""

    @F.arrow_udf(READ_BACK)
    def read(contents: pa.Array, types: pa.Array, lengths: pa.Array) -> pa.Array:
        out = []
        for data, kind, n in zip(contents, types.to_pylist(), lengths.to_pylist(), strict=True):
            data = data.as_py()
            if kind != "image/png" or n != len(data):
                raise ValueError(f"{kind} of {n} bytes where a PNG of {len(data)} was stored")
            payload, width, height = png_payload(data)
            histogram = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
            share = histogram[histogram > 0] / len(payload)
            mean = float(histogram @ np.arange(256)) / len(payload)
            feature = f"{kind};{width}x{height};mean={mean:.4f};entropy={float(-(share * np.log2(share)).sum()) + 0.0:.4f};levels={len(share)}"
            out.append({"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]), "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "feature": feature})
        return pa.array(out, pa.struct([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]))

    return read(content, media_type, length)
