"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with a group of WARC/1.1 records,
and ends with a skippable frame that holds a seek table: the compressed and decompressed
size of every frame (the public Zstandard seekable format). An index row for each record
names its bundle, its frame and its offset in the decompressed frame, so one record costs
one read of the footer and one frame.

Payloads that occur more than once are stored once: of equal payloads (from ``least_bytes``
on) the record with the largest id is the response, the others are revisits of it with the
payload's digest and size in their headers. Payloads count as equal if their SHA-1, a second
64-bit hash and their lengths agree.

Pages are written where they are read: no payload is shuffled unless the recurring ones are
too many to broadcast, and then once, by digest, where Spark splits hot ones. A task closes
its bundles by bytes, so memory and the number of bundles follow from the bytes and not
from the rows. File names hold the task's attempt; files that no index row names are left
by lost attempts.

Edge cases: a null payload is empty; a null URL gives an empty target; among rows with
equal payloads and equal largest ids (repeated rows) each is a response; null ids count
as smallest and are a revisit if the payload has another row with an id; ids are read as
64-bit integers, others raise; an empty table gives no bundle. Columns other than id, URL
and payload are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attempt_name, bounded_batches, materialize, open_bytes, text_or_empty, work_dir, write_bytes

# Fixed values of the Zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

#: Decompressed bytes after which a frame is closed.
FRAME_BYTES = 256 << 10
#: Decompressed bytes after which a bundle is closed.
BUNDLE_BYTES = 32 << 20
#: Recurring payloads up to which their digests are broadcast (some 100 bytes each).
BROADCAST_ORIGINALS = 500_000
#: Bundles that a task reads back.
READ_BUNDLES = 16


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer for frames of (compressed, decompressed) sizes."""
    entries = b"".join(struct.pack("<II", *f) for f in frames)
    body = entries + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


class Bundle:
    """Reads frames of a seekable file by its footer."""

    def __init__(self, file):
        self.file = file
        file.seek(0, io.SEEK_END)
        size = file.tell()
        file.seek(size - 9)
        count, descriptor, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        width = 12 if descriptor & 0x80 else 8
        file.seek(size - 9 - width * count)
        raw = file.read(width * count)
        self.frames, at = [], 0
        for i in range(count):
            packed, plain = struct.unpack_from("<II", raw, i * width)
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.frames[number]
        self.file.seek(at)
        return zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=plain)

    def record(self, number: int, offset: int) -> tuple[dict[str, str], bytes]:
        headers, body, _ = parse_record(self.frame(number), offset)
        return headers, body


def record_bytes(headers: list[tuple[str, str]], body: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(body)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers, body, offset of the next record)."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record at {at}")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    body = end + 4
    after = body + int(headers["Content-Length"])
    return headers, data[body:after], after + 4


def digest32(payload: bytes) -> str:
    """Bare upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _record_id(page_id: int | None, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"


def _header(text: str) -> str:
    """Header values hold no control characters."""
    return "".join(c if c >= " " else f"%{ord(c):02X}" for c in text)


def with_originals(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least_bytes: int) -> DataFrame:
    """page_id, url, payload and refers_to: the response's id for revisits, else null."""
    payload: Column = text_or_empty(payload_col)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    # Digests alone are compared; only payloads that recur have rows here.
    long_enough = F.octet_length("payload") >= least_bytes
    rows = rows.withColumn("sha1", F.sha1(F.col("payload").cast("binary"))).withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("h", F.when(long_enough, F.xxhash64("payload")))
    key = ["sha1", "n_bytes", "h"]
    recurring = materialize(rows.filter(long_enough).groupBy(*key).agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select(*key, "original"), "originals")
    few = recurring.limit(BROADCAST_ORIGINALS + 1).count() <= BROADCAST_ORIGINALS
    joined = rows.join(F.broadcast(recurring) if few else recurring, key, "left")
    refers = F.when(F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original")), F.col("original"))
    return joined.select("page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), refers.alias("refers_to"), "sha1", "n_bytes")


def write_bundles(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes the archives; the index: page_id, bundle, frame, offset, length."""
    spark = pages.sparkSession
    bounded_batches(spark)
    rows = with_originals(pages, id_col, url_col, payload_col, least_bytes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, frames, index, plain, total, number = io.BytesIO(), [], [], bytearray(), 0, 0
        pack, name = zstandard.ZstdCompressor(level=3), attempt_name()

        def close_frame() -> None:
            packed = pack.compress(bytes(plain))
            out.write(packed)
            frames.append((len(packed), len(plain)))
            plain.clear()

        def close() -> pa.RecordBatch:
            nonlocal out, total, number
            if plain:
                close_frame()
            path = write_bytes(folder, f"bundle-{name}-{number:05d}.warc.zst", out.getvalue() + seek_table(frames))
            ids, at, offset, length = zip(*index, strict=True)
            out, total, number = io.BytesIO(), 0, number + 1
            frames.clear(), index.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([path] * len(ids)), pa.array(at, pa.int32()), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], names=["page_id", "bundle", "frame", "offset", "length"]
            )

        for batch in batches:
            for r in batch.to_pylist():
                record = _page_record(r, date)
                if plain and len(plain) + len(record) > FRAME_BYTES:
                    close_frame()
                if index and total + len(record) > BUNDLE_BYTES:
                    yield close()
                index.append((r["page_id"], len(frames), len(plain), len(record)))
                plain += record
                total += len(record)
        if index:
            yield close()

    return materialize(rows.mapInArrow(write, "page_id long, bundle string, frame int, offset long, length long"), "index")


def _page_record(r: dict, date: str) -> bytes:
    common = [("WARC-Record-ID", _record_id(r["page_id"], r["url"])), ("WARC-Date", date), ("WARC-Target-URI", _header(r["url"])), ("X-Page-ID", "" if r["page_id"] is None else str(r["page_id"]))]
    if r["refers_to"] is not None:
        # The digest of the payload that isn't here, known since payloads were compared.
        digest = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
        return record_bytes([("WARC-Type", "revisit"), *common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(r["n_bytes"])), ("X-Refers-To-Page-ID", str(r["refers_to"]))], b"")
    payload = r["payload"].encode()
    return record_bytes([("WARC-Type", "response"), *common, ("Content-Type", "text/html; charset=utf-8"), ("WARC-Payload-Digest", f"sha1:{digest32(payload)}")], payload)


def read_bundles(spark: SparkSession, index: DataFrame) -> DataFrame:
    """Every record from the archives, found by the index: headers and verified payloads.

    page_id, payload_bytes, payload_digest, record_type, refers_to, url.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle in batch.to_pylist():
                out = []
                with open_bytes(bundle["bundle"]) as f:
                    archive, number, data = Bundle(f), -1, b""
                    for entry in sorted(bundle["records"], key=lambda e: (e["frame"], e["offset"])):
                        if entry["frame"] != number:
                            number, data = entry["frame"], archive.frame(entry["frame"])
                        headers, body, end = parse_record(data, entry["offset"])
                        if end - entry["offset"] != entry["length"] or headers["X-Page-ID"] != ("" if entry["page_id"] is None else str(entry["page_id"])):
                            raise ValueError(f"{bundle['bundle']}: the index doesn't fit")
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        response = headers["WARC-Type"] == "response"
                        if response and digest32(body) != digest:
                            raise ValueError(f"{bundle['bundle']}: a payload doesn't fit its digest")
                        refers = headers.get("X-Refers-To-Page-ID")
                        out.append((entry["page_id"], len(body) if response else int(headers["X-Payload-Length"]), digest, headers["WARC-Type"], None if refers is None else int(refers), headers["WARC-Target-URI"]))
                columns = zip(*out, strict=True)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    n = index.select("bundle").distinct().count()
    # Index rows are small and what they stand for isn't, so their bytes don't decide on the tasks.
    tasks = max(1, min(n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // READ_BUNDLES)))
    # A bundle's bytes are bounded, and so are its index rows.
    bundles = index.repartition(tasks, "bundle").groupBy("bundle").agg(F.collect_list(F.struct("page_id", "frame", "offset", "length")).alias("records"))
    return bundles.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def archive_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes pages to archives and returns what a reader of the archives finds."""
    spark = pages.sparkSession
    index = write_bundles(pages, folder or work_dir(spark, "warc"), id_col=id_col, url_col=url_col, payload_col=payload_col, least_bytes=least_bytes)
    return read_bundles(spark, index)
