"""Token ids in wavelet-matrix shards: a succinct file with access, counting and lookup.

A shard holds the ids of consecutive documents as one wavelet matrix (Claude, Navarro,
Ordóñez, "The wavelet matrix", 2015): one bit plane for each binary digit, most significant
first, where each plane lists the digits in the order left by stably moving the previous
plane's zeros to the front. Planes are compressed in blocks of 2^18 bits, and a directory
holds each block's ones and compressed size, which serves rank and select: single ids are
read, an id's occurrences counted in any range, and its k-th occurrence found, by unpacking
the blocks that they touch and no others.

File, little-endian: magic "WVMX0002"; header length (uint32); JSON header (n, levels,
zeros of each plane, length of the document table); document table (zstandard frame of an
Arrow stream of ids and lengths); the directory: for each plane the ones of its blocks, then
their compressed sizes (uint32 each); then the blocks, a zstandard frame each.

Documents go to shards in ascending id order: tasks of a range partitioning, whose number
follows from the bytes of text, write shards of their own. The manifest, a row for each
shard, is a table too, and distributed prefix sums over it give the ids before each shard.
File names hold the task's attempt; files that the manifest doesn't name are left by lost
attempts.

Edge cases: a null or empty text is one end id; null document ids sort first; documents
that share an id are ordered by the first 64 characters of their texts, then as they are
read, and may be dealt to several tasks; an empty table gives no shard and an empty result.
Columns other than the id and the text are not read.
"""

from __future__ import annotations

import io
import json
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import attempt_name, bounded_batches, materialize, open_bytes, text_or_empty, work_dir, write_bytes

MAGIC = b"WVMX0002"
#: Ids after which a shard is closed; a longer document has a shard of its own.
SHARD_TOKENS = 1 << 20
#: Bytes of text for each task that writes.
PARTITION_BYTES = 128 << 20
#: Tasks whose shards one task of the prefix sums orders.
GROUP_PARTS = 1024
#: Shards that a task reads back.
READ_SHARDS = 8
_BLOCK = 1 << 15  # bytes of bits that are compressed together


def build_wavelet(values: np.ndarray) -> tuple[int, list[int], list[np.ndarray]]:
    """(levels, zeros of each plane, bits of each plane)."""
    top = int(values.max()) if len(values) else 0
    levels = max(1, top.bit_length())
    kind = np.uint16 if levels <= 16 else np.uint32
    x, zeros, planes = values.astype(kind), [], []
    for level in range(levels - 1, -1, -1):
        ones = (x & kind(1 << level)) != 0
        planes.append(np.packbits(ones, bitorder="little"))
        low = x[~ones]
        zeros.append(len(low))
        if level:
            x = np.concatenate((low, x[ones]))
    return levels, zeros, planes


def shard_bytes(documents: pa.Table, values: np.ndarray) -> bytes:
    """documents: (doc_id, n_tokens) in order."""
    levels, zeros, planes = build_wavelet(values)
    stream = io.BytesIO()
    with pa.ipc.new_stream(stream, documents.schema) as writer:
        writer.write_table(documents)
    table = zstandard.ZstdCompressor(level=3).compress(stream.getvalue())
    header = json.dumps({"n": len(values), "levels": levels, "zeros": zeros, "table": len(table)}).encode()
    pack, directory, blocks = zstandard.ZstdCompressor(level=1), [], []
    for plane in planes:
        parts = [plane[at : at + _BLOCK] for at in range(0, len(plane), _BLOCK)]
        packed = [pack.compress(part.tobytes()) for part in parts]
        directory += [np.array([np.bitwise_count(part).sum() for part in parts], "<u4").tobytes(), np.array([len(x) for x in packed], "<u4").tobytes()]
        blocks += packed
    return b"".join([MAGIC, len(header).to_bytes(4, "little"), header, table, *directory, *blocks])


class WaveletShard:
    """Reads a shard. Blocks are read and unpacked when first needed."""

    def __init__(self, file, cached_blocks: int = 256):
        self.file = file
        if file.read(8) != MAGIC:
            raise ValueError("not a wavelet shard")
        header = json.loads(file.read(int.from_bytes(file.read(4), "little")))
        self.n, self.levels, self.zeros = header["n"], header["levels"], header["zeros"]
        stream = zstandard.ZstdDecompressor().decompress(file.read(header["table"]))
        self.documents = pa.ipc.open_stream(stream).read_all().combine_chunks()
        blocks = -(-self.n // (8 * _BLOCK))
        directory = np.frombuffer(file.read(8 * self.levels * blocks), "<u4").reshape(self.levels, 2, blocks).astype(np.int64)
        #: Ones before each block of each plane, and at the end.
        self.ones = np.concatenate((np.zeros((self.levels, 1), np.int64), directory[:, 0].cumsum(axis=1)), axis=1)
        self.sizes = directory[:, 1]
        self.at = (file.tell() + self.sizes.ravel().cumsum() - self.sizes.ravel()).reshape(self.sizes.shape)
        self.block = lru_cache(cached_blocks)(self._block)

    def _block(self, k: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(words, ones before each word) of a block of plane k."""
        words = np.frombuffer(self._bits(k, b).ljust(_BLOCK, b"\0"), "<u8")
        counts = np.bitwise_count(words).astype(np.int64)
        return words, counts.cumsum() - counts

    def _bits(self, k: int, b: int) -> bytes:
        self.file.seek(int(self.at[k, b]))
        return zstandard.ZstdDecompressor().decompress(self.file.read(int(self.sizes[k, b])), max_output_size=_BLOCK)

    def _ranks(self, k: int, at: np.ndarray) -> np.ndarray:
        """Ones among the first bits of plane k, for each number of bits."""
        out, block = np.empty(len(at), np.int64), at // (8 * _BLOCK)
        for b in np.unique(block).tolist():
            here = np.flatnonzero(block == b)
            if b == self.sizes.shape[1]:
                out[here] = self.ones[k, b]
                continue
            words, before = self.block(k, b)
            i = at[here] - b * 8 * _BLOCK
            rest = words[i // 64] & ((np.uint64(1) << (i % 64).astype(np.uint64)) - np.uint64(1))
            out[here] = self.ones[k, b] + before[i // 64] + np.bitwise_count(rest)
        return out

    def _rank(self, k: int, i: int) -> int:
        return int(self._ranks(k, np.array([i]))[0])

    def access_many(self, positions: np.ndarray) -> np.ndarray:
        """The ids at these positions."""
        i, value = positions.astype(np.int64), np.zeros(len(positions), np.int64)
        for k in range(self.levels):
            ones = self._ranks(k, i)
            bit = self._ranks(k, i + 1) - ones
            i = np.where(bit == 1, self.zeros[k] + ones, i - ones)
            value = value << 1 | bit
        return value

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.access_many(np.array([i]))[0])

    def _range(self, value: int, start: int, end: int) -> tuple[int, int]:
        """Where the occurrences in [start, end) stand after the last plane."""
        if value >> self.levels:
            return 0, 0
        for k in range(self.levels):
            a, b = self._rank(k, start), self._rank(k, end)
            if value >> (self.levels - 1 - k) & 1:
                start, end = self.zeros[k] + a, self.zeros[k] + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of an id among positions [start, end)."""
        a, b = self._range(value, start, self.n if end is None else end)
        return b - a

    def _select(self, k: int, bit: int, j: int) -> int:
        """Position of the j-th (from 0) such bit in plane k."""
        until = self.ones[k] if bit else np.minimum(np.arange(self.sizes.shape[1] + 1) * 8 * _BLOCK, self.n) - self.ones[k]
        b = int(np.searchsorted(until, j, side="right")) - 1
        words, before = self.block(k, b)
        j -= int(until[b])
        ahead = before if bit else np.arange(len(words)) * 64 - before
        w = int(np.searchsorted(ahead, j, side="right")) - 1
        j -= int(ahead[w])
        word = int(words[w]) if bit else ~int(words[w]) & (1 << 64) - 1
        for _ in range(j):
            word &= word - 1
        return (b * _BLOCK * 8) + w * 64 + (word & -word).bit_length() - 1

    def find(self, value: int, j: int) -> int:
        """Position of the j-th occurrence (from 0) of an id, or -1."""
        a, b = self._range(value, 0, self.n)
        if not 0 <= j < b - a:
            return -1
        i = a + j
        for k in range(self.levels - 1, -1, -1):
            bit = value >> (self.levels - 1 - k) & 1
            i = self._select(k, bit, i - self.zeros[k] if bit else i)
        return i

    def all(self) -> np.ndarray:
        """All ids: undoes each plane's stable move, from the last to the first."""
        x = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for k in range(self.levels - 1, -1, -1):
            bits = np.frombuffer(b"".join(self._bits(k, b) for b in range(self.sizes.shape[1])), np.uint8)
            ones = np.unpackbits(bits, count=self.n, bitorder="little").view(np.bool_)
            before = np.empty_like(x)
            before[~ones] = x[: self.zeros[k]]
            before[ones] = x[self.zeros[k] :] | x.dtype.type(1 << (self.levels - 1 - k))
            x = before
        return x


def write_shards(docs: DataFrame, tokenizer: str, folder: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes the shards; the manifest: part, shard, path, tokens."""
    spark = docs.sparkSession
    bounded_batches(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        encode, end, attempt = encoder(tokenizer).encode, end_id.to_bytes(4, "little"), attempt_name()
        names, ids, lengths, tokens, number, kind = [], [], [], 0, 0, None

        def close() -> pa.RecordBatch:
            values = np.frombuffer(b"".join(ids), "<u4")
            documents = pa.table({"doc_id": pa.array(names, kind), "n_tokens": pa.array(lengths, pa.int64())})
            path = write_bytes(folder, f"part-{attempt}-{number:05d}.wvmx", shard_bytes(documents, values))
            part = int(attempt.split("-")[0])
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([path]), pa.array([len(values)], pa.int64())], names=["part", "shard", "path", "tokens"])

        for batch in batches:
            kind = batch.column(0).type
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                got = encode(text.as_py()) + end
                if lengths and tokens + len(got) // 4 > shard_tokens:
                    yield close()
                    names, ids, lengths, tokens, number = [], [], [], 0, number + 1
                names.append(name.as_py())
                ids.append(got)
                lengths.append(len(got) // 4)
                tokens += len(got) // 4
        if lengths:
            yield close()

    text = text_or_empty(text_col)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / PARTITION_BYTES))
    # Rows that share an id are told apart, so that no range must hold them all.
    order = ["doc_id", "head", "read"]
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.substring(text, 1, 64).alias("head"), F.monotonically_increasing_id().alias("read"))
    in_order = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return materialize(in_order.mapInArrow(write, "part int, shard int, path string, tokens long"), "manifest")


def shard_starts(manifest: DataFrame) -> DataFrame:
    """path, start: the ids of all shards before it. Groups of tasks are summed first, so no task orders all shards."""
    grouped = manifest.withColumn("group", F.floor(F.col("part") / F.lit(GROUP_PARTS)))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    groups = grouped.groupBy("group").agg(F.sum("tokens").alias("tokens")).select(F.col("group").alias("of"), before("tokens", Window.orderBy("group")).alias("group_start"))
    within = grouped.withColumn("at", before("tokens", Window.partitionBy("group").orderBy("part", "shard")))
    # A row for each thousand tasks.
    return within.join(F.broadcast(groups), F.col("group") == F.col("of")).select("path", (F.col("group_start") + F.col("at")).alias("start"))


def read_shards(spark: SparkSession, manifest: DataFrame, id_type: str = "long", end_id: int = 0) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and first_id, from the files alone.

    first_id is read by position, and the shard's end ids are counted, through the directory.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_bytes(row["path"]) as f:
                    shard = WaveletShard(f)
                    ids = shard.all().astype("<u4")
                    lengths = shard.documents["n_tokens"].to_numpy()
                    ends = np.cumsum(lengths)
                    starts = ends - lengths
                    first = shard.access_many(starts)
                    if shard.count(end_id) < len(lengths):
                        raise ValueError(f"{row['path']}: documents without an end")
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                out = [shard.documents["doc_id"].combine_chunks(), pa.array(starts + row["start"]), pa.array(lengths), pa.array(crcs, pa.int64()), pa.array(first)]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32", "first_id"])

    n = manifest.count()
    tasks = max(1, min(n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // READ_SHARDS)))
    return shard_starts(manifest).repartition(tasks, "path").mapInArrow(read, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long, first_id long")


def tokenise_to_shards(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, shard_tokens: int = SHARD_TOKENS, folder: str | None = None) -> DataFrame:
    """Writes all documents' ids and returns what a reader of the files finds."""
    spark = docs.sparkSession
    folder = folder or work_dir(spark, "tokens")
    manifest = write_shards(docs, tokenizer, folder, id_col=id_col, text_col=text_col, end_id=end_id, shard_tokens=shard_tokens)
    return read_shards(spark, manifest, docs.schema[id_col].dataType.simpleString(), end_id)
