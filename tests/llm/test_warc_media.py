import base64
import gzip
import hashlib
import io
import struct
import time
import wave
import zipfile
import zlib
from collections import Counter, defaultdict

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meridia.llm import media as M
from meridia.llm import warc as W
from meridia.llm.common import local_path
from meridia.llm.queries import op2_warc, op8_media

from ..conftest import DATA


def expected(pages):
    by = defaultdict(list)
    for page_id, _, payload in pages:
        by[payload or ""].append(page_id)
    out = []
    for page_id, _, payload in pages:
        raw, ids = (payload or "").encode(), by[payload or ""]
        known = [i for i in ids if i is not None]
        original = max(known) if known and len(ids) > 1 else page_id
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((page_id, len(raw), digest, "response" if page_id == original else "revisit", None if page_id == original else original))
    return Counter(out)


def rows(df):
    return Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


def test_warc_query(spark):
    pages = spark.read.parquet(f"{DATA}/sf0.01/pages.parquet").select("page_id", "url", "html").collect()
    assert rows(op2_warc(spark, f"{DATA}/sf0.01")) == expected(pages)


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a/", "same"), (2, "http://b/", "same"), (3, None, None), (4, "u\r\nX: y", ""), (None, "http://n/", "same"), (5, "http://c/", "é" * 400_000), (6, "http://d/", "alone\r\n\r\nWARC/1.1"), (2, "http://b/", "same"), (7, "http://e/", "x" * 100)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha1", F.lit("clash")).withColumn("bundle", F.lit(1))


def test_warc_edges(spark, pages):
    assert rows(W.archive_pages(pages)) == expected(pages.select("page_id", "url", "html").collect())
    assert W.archive_pages(pages.limit(0)).collect() == []
    some = W.archive_pages(pages, least_bytes=50).filter("record_type = 'revisit'")
    assert some.collect() == []


def test_records_by_index_and_whole_files(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "FRAME_BYTES", 600)
    index = W.write_bundles(pages, str(tmp_path)).collect()
    assert {r.frame for r in index} > {0}
    for r in index:
        with open(local_path(r.bundle), "rb") as f:
            headers, body = W.Bundle(f).record(r.frame, r.offset)
        assert headers["X-Page-ID"] == ("" if r.page_id is None else str(r.page_id))
    # Any Zstandard reader gets all records in a row: the seek table is a skippable frame.
    count = 0
    for path in {r.bundle for r in index}:
        with open(local_path(path), "rb") as f:
            data, at = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read(), 0
        while at < len(data):
            _, _, at = W.parse_record(data, at)
            count += 1
    assert count == len(index)


def test_bundles_are_closed_by_bytes(spark, tmp_path, monkeypatch):
    """Equal, null and many ids: bundles stay small, and the result whole, by broadcast or by shuffle."""
    monkeypatch.setattr(W, "BUNDLE_BYTES", 4000)
    rows_ = [(None if i % 3 else 5, f"http://{i}/", "hot" if i % 2 else f"page {i}" * 20) for i in range(300)]
    df = spark.createDataFrame(rows_, "page_id long, url string, html string")
    for n, most in enumerate((10, 0)):
        monkeypatch.setattr(W, "BROADCAST_ORIGINALS", most)
        assert rows(W.archive_pages(df, folder=str(tmp_path / str(n)))) == expected(rows_)
        sizes = [p.stat().st_size for p in (tmp_path / str(n)).iterdir()]
        assert len(sizes) > 15 and max(sizes) < 6000


def read_png(data):
    """An independent reader: all filter types, by the specification."""
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, packed, size = 8, b"", None
    while at < len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + body) == int.from_bytes(data[at + 8 + n : at + 12 + n], "big")
        if kind == b"IHDR":
            size, rest = struct.unpack(">II", body[:8]), body[8:]
            assert rest == b"\x08\0\0\0\0"
        packed += body * (kind == b"IDAT")
        at += 12 + n
    raw, (width, height), out, above = zlib.decompress(packed), size, b"", bytes(size[0])
    for y in range(height):
        kind, line = raw[y * (width + 1)], bytearray(raw[y * (width + 1) + 1 : (y + 1) * (width + 1)])
        for x in range(width):
            a, b, c = (line[x - 1] if x else 0), above[x], (above[x - 1] if x else 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line[x] = (line[x] + (0, a, b, (a + b) // 2, paeth)[kind]) % 256
        above = bytes(line)
        out += above
    return out


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=1000))
def test_stored_bytes_by_another_reader(raw):
    payload = M.pad_payload(raw)
    assert read_png(M.payload_png(payload)) == payload


def test_media_query_edges(spark, edge_docs, empty_docs, tmp_path):
    for n, docs in enumerate((edge_docs, empty_docs)):
        docs.write.parquet(str(tmp_path / str(n) / "documents.parquet"))
        wanted = []
        for r in docs.collect():
            raw = (r.text or "").encode()
            padded = M.pad_payload(raw)
            wanted.append((r.doc_id, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]), "image/png", len(raw) % 2 == 1, 0))
        got = op8_media(spark, str(tmp_path / str(n))).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_type", "corrected", "n_embedded")
        assert Counter(tuple(r) for r in got.collect()) == Counter(wanted)


def test_hostile_media_is_linear():
    for data in (b"%PDF-" * 40_000, b"PK\3\4" * 40_000, b"\x1f\x8b\x08\0" * 40_000, b"\xff\xd8\xff" * 40_000, b"BM" * 60_000, b"RIFF" * 40_000, b"OggS" * 40_000, b"ftyp" * 40_000):
        began = time.perf_counter()
        M.sniff(data)
        assert time.perf_counter() - began < 1, data[:8]


def test_media_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()}
    got = op8_media(spark, f"{DATA}/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        raw = (docs[r.doc_id] or "").encode()
        padded = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert r.media_sha256 == hashlib.sha256(M.payload_png(padded)).hexdigest() and r.feature.startswith("image/png;192x")


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=1000))
def test_payload_round_trip(raw):
    payload = M.pad_payload(raw)
    assert payload.startswith(raw) and len(payload) % 192 == 0 and payload and not payload[len(raw) :].strip(b" ")
    png = M.payload_png(payload)
    assert M.png_payload(png) == (payload, 192, len(payload) // 192) and M.sniff(png) == [("image/png", 0, len(png))]


def samples():
    wav = io.BytesIO()
    with wave.open(wav, "wb") as w:
        w.setnchannels(1), w.setsampwidth(1), w.setframerate(8000), w.writeframes(b"\x80" * 101)
    zipped = io.BytesIO()
    with zipfile.ZipFile(zipped, "w") as z:
        z.writestr("a.txt", "hello")
    box = lambda kind, body: struct.pack(">I4s", 8 + len(body), kind) + body
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"\x2c" + b"\0" * 8 + b"\0" + b"\x02" + b"\x02\x44\x01" + b"\0" + b"\x3b"
    jpeg = b"\xff\xd8\xff\xe0\x00\x10JFIF\0" + b"\0" * 9 + b"\xff\xc0\x00\x0b\x08\0\x01\0\x01\x01\x01\x11\0" + b"\xff\xda\x00\x08\x01\x01\0\0\x3f\0" + b"\x12\xff\x00\x34\xff\xd0\x56" + b"\xff\xd9"
    ogg = b"OggS\0\x06" + b"\0" * 20 + b"\x01\x05" + b"hello"
    aiff = b"FORM" + struct.pack(">I", 4 + 8 + 18) + b"AIFF" + b"COMM" + struct.pack(">I", 18) + b"\0" * 18
    webp = b"RIFF" + struct.pack("<I", 4 + 8 + 4) + b"WEBPVP8L" + struct.pack("<I", 4) + b"abcd"
    bmp = b"BM" + struct.pack("<IIIIiiHHIIIIII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0" * 4
    pdf = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF"
    return {
        "image/png": M.payload_png(b"x" * 192), "audio/wav": wav.getvalue(), "application/zip": zipped.getvalue(), "application/gzip": gzip.compress(b"some text" * 50), "image/gif": gif, "image/jpeg": jpeg,
        "audio/ogg": ogg, "audio/aiff": aiff, "image/webp": webp, "image/bmp": bmp, "application/pdf": pdf, "video/mp4": box(b"ftyp", b"isom0000") + box(b"moov", b"1234"),
    }


@pytest.mark.parametrize("kind", list(samples()))
def test_sniffing_each_format(kind):
    data = samples()[kind]
    size = len(data)
    assert M.sniff(data) == [(kind, 0, size)]
    assert M.sniff(b"some text before " + data + b" and after") == [(kind, 17, size)]
    assert not [x for x in M.sniff(data[:-3]) if x[0] == kind]


def pdf(body=b"", stream=False):
    """A whole PDF, its offset right, with a table or a stream of cross-references."""
    data = b"%PDF-1.4\n1 0 obj\n" + body + b"\nendobj\n"
    return data + (b"2 0 obj\n<</Type/XRef>>\nendobj\n" if stream else b"xref\n0 1\ntrailer\n") + b"startxref\n%d\n%%%%EOF" % len(data)


def updated_pdf(data, stream=False):
    more = data + b"\n3 0 obj\nendobj\n"
    return more + (b"4 0 obj\n<</Type/XRef>>\nendobj\n" if stream else b"xref\n0 1\ntrailer\n") + b"startxref\n%d\n%%%%EOF" % len(more)


def linearized_pdf(body=b""):
    first = b"%PDF-1.4\n1 0 obj\n<</Linearized 1/L 0000000000>>\nendobj\nxref\n0 1\ntrailer\nstartxref\n0\n%%EOF\n"
    data = first + b"2 0 obj\n" + body + b"\nendobj\nxref\n0 1\ntrailer\nstartxref\n%d\n%%%%EOF" % first.index(b"xref")
    return data.replace(b"/L 0000000000", b"/L %010d" % len(data))


@pytest.mark.parametrize("stream", [False, True])
def test_whole_pdfs(stream):
    plain, png = pdf(stream=stream), samples()["image/png"]
    twice = updated_pdf(updated_pdf(pdf(png, stream), stream), stream)
    for data in (twice, linearized_pdf(png), updated_pdf(linearized_pdf(png), stream), pdf(plain, stream), updated_pdf(pdf(twice, stream), stream), linearized_pdf(plain), updated_pdf(linearized_pdf(twice), stream)):
        n = len(data)
        assert M.sniff(data) == [("application/pdf", 0, n)]
        assert M.sniff(b"text " + data + b" and after") == [("application/pdf", 5, n)]
        # Files in a row stay apart, copies too.
        assert M.sniff(data + b"\n" + data + b"\n" + plain) == [("application/pdf", 0, n), ("application/pdf", n + 1, n), ("application/pdf", 2 * n + 2, len(plain))]


def test_many_pdf_marks_are_linear():
    for data in (b"%PDF-" * 100_000, b"%PDF-%%EOF" * 50_000, pdf() * 10_000, b"%PDF-" + b"1" * 500_000 + b" 0 obj" * 50_000):
        M.sniff(data)


def test_mp4_boxes_of_any_size():
    box = lambda kind, body: struct.pack(">I4s", 8 + len(body), kind) + body
    long_box = lambda kind, body: struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body
    to_the_end = lambda kind, body: struct.pack(">I4s", 0, kind) + body
    png = samples()["image/png"]
    start, moov = box(b"ftyp", b"isom0000"), box(b"moov", b"1234")
    data = start + long_box(b"mdat", png) + moov
    assert M.sniff(data) == [("video/mp4", 0, len(data))]
    assert M.sniff(b"text " + data + b" and after") == [("video/mp4", 5, len(data))]
    assert "video/mp4" not in [k for k, _, _ in M.sniff(data[:-3])]
    for last in (start + moov + to_the_end(b"mdat", png), start + long_box(b"mdat", png) + to_the_end(b"moov", b"1234")):
        assert M.sniff(last) == [("video/mp4", 0, len(last))]
    # A 64-bit size below its own header, or beyond the data, is no box; nor are zeros and text.
    for rest in (struct.pack(">I4sQ", 1, b"mdat", 15) + b"x" * 20, struct.pack(">I4sQ", 1, b"mdat", 2**63) + b"x" * 20, struct.pack(">I4s", 1, b"mdat"), b"\0\0\0\0text after"):
        assert M.sniff(start + moov + rest) == [("video/mp4", 0, len(start + moov))]


def zip_of(*bodies, note=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, body in enumerate(bodies):
            z.writestr(f"{n}", body)
        z.comment = note
    return out.getvalue()


def test_zip_that_stores_zips():
    inner = zip_of(b"hello", note=b"note")
    for data in (zip_of(inner), zip_of(b"first", inner, zip_of(inner)), zip_of(b"PK\x05\x06" + b"\0" * 18)):
        assert M.sniff(data) == [("application/zip", 0, len(data))]
        assert M.sniff(b"text " + data + data + b" and after") == [("application/zip", 5, len(data)), ("application/zip", 5 + len(data), len(data))]
    # Without the outer end record, what is whole inside is still found.
    cut = zip_of(inner)[:-3]
    assert M.sniff(cut) == [("application/zip", cut.index(inner), len(inner))]
    M.sniff(b"PK\x03\x04" * 50_000 + b"PK\x05\x06" * 50_000)


def test_media_column_edges(spark):
    s = samples()
    rows = [(1, bytearray(s["image/png"]), "image/jpeg"), (2, None, None), (3, bytearray(b""), "x"), (4, bytearray(b"text" + s["image/gif"] + s["audio/wav"]), "text/plain"), (5, bytearray(s["audio/wav"]), "audio/wav"), (6, bytearray(b"PK\x03\x04" * 10_000), "a")]
    df = spark.createDataFrame(rows, "id int, content binary, declared string").withColumn("media_type", F.lit("clash"))
    got = {r.id: r.s for r in df.select("id", M.sniff_column(F.col("content"), F.col("declared")).alias("s")).collect()}
    assert (got[1].media_type, got[1].corrected, got[1].length) == ("image/png", True, len(s["image/png"]))
    assert all(got[i].media_type is None and got[i].embedded == [] for i in (2, 3, 6))
    assert [(e.media_type, e.offset) for e in got[4].embedded] == [("image/gif", 4), ("audio/wav", 4 + len(s["image/gif"]))] and got[4].media_type is None
    assert got[5].corrected is False
