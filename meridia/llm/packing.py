"""Best-fit decreasing packing of tokenised documents into fixed-length sequences.

Only the number of pieces of each length matters to best fit: pieces of one length are
interchangeable. So the packing runs on the driver over a histogram of at most
``capacity`` rows, whatever the input's size: a segment tree over remaining capacities
finds the tightest open sequence in logarithmic time, and runs of sequences with an equal
history are handled together. The plan comes back as rank ranges, and every piece finds
its sequence by its rank among the pieces of its length, which distributed prefix sums give.

Edge cases: a null or empty text is one piece holding just the end id; pieces of one
length and id rank by (id, piece, crc), so repeated rows get sequences of their own; a
null id sorts first; an empty table gives an empty result. Columns of the input other
than the id and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

import math
import sys
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, text_or_empty

#: Pieces of one length that one task ranks.
RANK_ROWS = 20_000
#: Units the tokeniser remembers: fewer than elsewhere, as the pipeline's workers hold other stages' memory too.
MEMO_UNITS = 400_000


class OpenSequences:
    """Runs of open sequences by remaining capacity, under a segment tree of run counts."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.tree[node] += by
            node //= 2

    def push(self, room: int, first: int, count: int) -> None:
        if room and count:
            self.runs[room].append((first, count))
            self._add(room, 1)

    def pop(self, room: int) -> tuple[int, int]:
        self._add(room, -1)
        return self.runs[room].pop()

    def tightest(self, need: int) -> int:
        """The least remaining capacity of at least need with an open sequence, or -1."""
        node = need + self.size
        if self.tree[node]:
            return need
        while node > 1 and (node & 1 or not self.tree[node ^ 1]):
            node //= 2
        if node <= 1:
            return -1
        node ^= 1
        while node < self.size:
            node = 2 * node if self.tree[2 * node] else 2 * node + 1
        return node - self.size


def best_fit_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first sequence, pieces each, offset).

    Pieces of that length with ranks in [first, end) go to consecutive sequences, so
    many in each, from that offset on. Identical to placing the pieces one by one.
    """
    plan, open_, sequences = [], OpenSequences(capacity), 0
    for length in sorted((n for n in histogram if histogram[n]), reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = open_.tightest(length)
            if room < 0:
                # As many fresh sequences as the rest fills, each tightest until full.
                each = capacity // length
                count = max(1, left // each)
                open_.push(capacity, sequences, count)
                sequences += count
                continue
            first, count = open_.pop(room)
            each = min(room // length, left)
            used = min(count, left // each)
            open_.push(room, first + used, count - used)
            plan.append((length, rank, rank + used * each, first, each, capacity - room))
            open_.push(room - each * length, first, used)
            rank, left = rank + used * each, left - used * each
    return plan


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, capacity: int, end_id: int, keep_ids: bool = False) -> DataFrame:
    """One row for each piece: the whole text's ids and the end id, cut at capacity."""
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    if keep_ids:
        schema = f"doc_id {id_type.simpleString()}, piece int, start long, length long, ids_crc32 long, ids binary"
    else:
        schema = f"doc_id {id_type.simpleString()}, piece int, start long, length long, ids_crc32 long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        encode, end, step = encoder(tokenizer, MEMO_UNITS).encode, end_id.to_bytes(4, "little"), 4 * capacity
        assert sys.byteorder == "little"
        for batch in batches:
            rows, piece, start, length, crc, kept = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = encode(text) + end
                for n, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append(row)
                    piece.append(n)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        kept.append(part)
            out = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                out.append(pa.array(kept, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(cut, schema)


def pack_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Packs documents into as few sequences of at most capacity ids as best fit finds.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with
    keep_ids the ids themselves as little-endian unsigned 32-bit integers.
    """
    spark = docs.sparkSession
    # Written once: the text is tokenised a single time, and ranks survive lost executors.
    pieces = materialize(token_pieces(docs, tokenizer, id_col, text_col, capacity, end_id, keep_ids), "pieces")
    # At most `capacity` rows, as no piece is longer.
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = best_fit_plan(histogram, capacity)
    # The plan's size depends on the capacity, not on the data, hence the broadcast.
    places = spark.createDataFrame(plan, "p_length long, p_first long, p_end long, p_sequence long, p_each long, p_offset long")

    salts = max(16, math.ceil(max(histogram.values(), default=0) / RANK_ROWS))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = (
        salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    )
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        salted.withColumn("row", F.row_number().over(within) - 1)
        .join(before, ["length", "salt"])
        .withColumn("rank", F.col("row") + F.col("before"))
    )
    step = F.col("rank") - F.col("p_first")
    out = ranked.join(F.broadcast(places), (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("p_first")) & (F.col("rank") < F.col("p_end")))
    return out.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("p_sequence") + F.floor(step / F.col("p_each"))).cast("long").alias("sequence_id"),
        (F.col("p_offset") + F.pmod(step, F.col("p_each")) * F.col("length")).cast("long").alias("offset"),
        *(["ids"] if keep_ids else []),
    )
