"""Comparing the rows of a cell with each other, in blocks of bounded size.

Rows (entries) stand in cells or only probe them; a pair meets in a cell if one stands
there. Of each cell, at most some BLOCK_ROWS standing and as many probing rows meet in a
task; larger cells are dealt by hash to a grid of such blocks, in which every pair meets
once for each order. Tasks read whole blocks one after the other, so none holds a cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

BLOCK_ROWS = 256
#: Entries of a cell up to which its pairs are listed together with those of other cells.
SMALL_RUN = 16
#: Large cells up to which they are broadcast (some 40 bytes each), and the parts of each beyond that.
BROADCAST_CELLS = 200_000
CELL_PARTS = 32

BY_BLOCK = ["t", "cell", "i", "j"]
STANDS_AND_PROBES, STANDS, PROBES = 0, 1, 2


def deal(entries: DataFrame, grid: bool = True) -> DataFrame:
    """Entries dealt to blocks (t, cell, i, j) of bounded size, with the side they take there.

    Without the grid, every entry goes to one block: that of its part (i) of a large cell, where
    j > 0 tells that not all pairs meet. All entries have to be standing ones then.
    """
    parts = lambda n: F.ceil(F.col(n) / F.lit(float(BLOCK_ROWS))).cast("int")
    sizes = entries.groupBy("t", "cell").agg(F.sum(F.col("own").cast("int")).alias("n_own"), F.count(F.lit(1)).alias("n_all"))
    large = materialize(sizes.filter((F.col("n_all") > BLOCK_ROWS) & (F.col("n_own") > 0)).select("t", "cell", parts("n_own").alias("is"), parts("n_all").alias("js")), "large")
    many = large.limit(BROADCAST_CELLS + 1).count() > BROADCAST_CELLS
    if many:
        # A large cell's entries meet its size in as many places as it has parts.
        part: Column = F.pmod(F.xxhash64("node"), F.lit(CELL_PARTS)).cast("int")
        spread = large.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(CELL_PARTS - 1))))
        joined = entries.withColumn("part", part).join(spread, ["t", "cell", "part"], "left").drop("part")
    else:
        joined = entries.join(F.broadcast(large), ["t", "cell"], "left")
    kept = [c for c in entries.columns if c not in ("t", "cell")]
    whole = joined.filter("is is null").select("t", "cell", F.lit(0).alias("i"), F.lit(0).alias("j"), F.when(F.col("own"), STANDS_AND_PROBES).otherwise(PROBES).alias("side"), *kept)
    # What stands in a large cell goes to its row of the grid, and everything to its column.
    salt = lambda n: F.pmod(F.xxhash64("node", F.lit(n)), F.col(n)).cast("int")
    last = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cut = joined.filter("is is not null")
    parts_ = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not grid:
        # Dealt anew in each cell, so that the cells together connect the parts of each.
        part = F.pmod(F.xxhash64("node", "t", "cell"), F.col("is")).cast("int")
        once = whole.unionByName(cut.select("t", "cell", part.alias("i"), F.lit(1).alias("j"), F.lit(STANDS_AND_PROBES).alias("side"), *kept))
        return once.repartition(parts_, *BY_BLOCK).sortWithinPartitions(*BY_BLOCK)
    standing = cut.filter("own").select("t", "cell", salt("is").alias("i"), F.explode(last("js")).alias("j"), F.lit(STANDS).alias("side"), *kept)
    probing = cut.select("t", "cell", F.explode(last("is")).alias("i"), salt("js").alias("j"), F.lit(PROBES).alias("side"), *kept)
    return whole.unionByName(standing).unionByName(probing).repartition(parts_, *BY_BLOCK).sortWithinPartitions(*BY_BLOCK)


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Tables of whole blocks in their order, with where each starts and ends; a block waits for its end."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        keys = np.column_stack([table[c].to_numpy() for c in BY_BLOCK])
        starts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1))
        if len(starts) > 1:
            yield table.slice(0, starts[-1]).combine_chunks(), starts[:-1], starts[1:]
        rest = table.slice(starts[-1])
    if rest is not None and len(rest):
        yield rest.combine_chunks(), np.array([0]), np.array([len(rest)])


def small_pairs(starts: np.ndarray, ends: np.ndarray, side: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b) of all pairs in small blocks where one stands and the other probes."""
    small = (ends - starts > 1) & (ends - starts <= SMALL_RUN)
    sizes = (ends - starts)[small]
    until = np.repeat(ends[small], sizes)
    rows = np.repeat(starts[small] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(until))
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lag in range(1, SMALL_RUN):
        keep = rows + lag < until
        rows, until = rows[keep], until[keep]
        found_a.append(rows)
        found_b.append(rows + lag)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    fit = ((side[a] != PROBES) & (side[b] != STANDS) | (side[b] != PROBES) & (side[a] != STANDS)) & (node[a] != node[b])
    return a[fit], b[fit]


def resembling(dealt: DataFrame, sketch: list[str], most_bits: int) -> DataFrame:
    """(node, at): for each node its entries (t, cell, own) whose sketch is close to another's in the cell.

    A node has a bounded number of entries, so a row for each node is bounded too.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, ends in whole_blocks(batches):
            side, node = table["side"].to_numpy(), table["node"].to_numpy()
            # Unsigned: numpy counts the bits of absolute values.
            words = [table[c].to_numpy().view(np.uint64) for c in sketch]
            close = np.zeros(len(table), np.bool_)
            a, b = small_pairs(starts, ends, side, node)
            near = sum(np.bitwise_count(w[a] ^ w[b]).astype(np.int16) for w in words) <= most_bits
            close[a[near]] = close[b[near]] = True
            for n in np.flatnonzero(ends - starts > SMALL_RUN).tolist():
                at = np.arange(starts[n], ends[n])
                a, b = at[side[at] != PROBES], at[side[at] != STANDS]
                if len(a) and len(b):
                    near = sum(np.bitwise_count(w[a][:, None] ^ w[b]).astype(np.int16) for w in words) <= most_bits
                    near &= node[a][:, None] != node[b]
                    close[a[near.any(axis=1)]] = close[b[near.any(axis=0)]] = True
            if close.any():
                yield from table.filter(pa.array(close)).select(["node", "t", "cell", "own"]).to_batches()

    kept = dealt.mapInArrow(keep, "node long, t int, cell long, own boolean")
    return kept.groupBy("node").agg(F.collect_set(F.struct("t", "cell", "own")).alias("at"))


def with_columns(close: DataFrame, nodes: DataFrame) -> DataFrame:
    """The entries that resembling() keeps, with their nodes' columns."""
    joined = nodes.join(close, "node")
    return joined.withColumn("entry", F.explode("at")).select("entry.t", "entry.cell", "entry.own", *nodes.columns)


class Forest:
    """Spanning forests of the links seen so far."""

    def __init__(self):
        self.above: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def _top(self, x: int) -> int:
        above = self.above
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above.setdefault(up, up)
        return x

    def joins(self, a: int, b: int) -> bool:
        return self._top(a) == self._top(b)

    def add(self, a: int, b: int) -> bool:
        """Whether the link connects what was apart."""
        x, y = self._top(a), self._top(b)
        if x != y:
            self.above[y] = x
            self.edges.append((a, b))
        return x != y


class NearestLinks:
    """Minimum spanning forests of all links added, each of what those before it leave.

    Links are ordered by distance, then by nodes, so the forests don't depend on the order
    of arrival, nor on when links that can't be among them any more are dropped.
    """

    #: Links held besides those of the forests.
    HELD = 1 << 18

    def __init__(self, forests: int):
        self.forests, self.held, self.kept = forests, 0, 0
        self.parts: list[np.ndarray] = []

    def add(self, a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> None:
        if len(a):
            self.parts.append(np.stack([np.minimum(a, b), np.maximum(a, b), distance.astype(np.int64)]))
            self.held += len(a)
            if self.held > self.HELD + 2 * self.kept:
                self._reduce()

    def _reduce(self) -> None:
        low, high, distance = np.concatenate(self.parts, axis=1)
        order = np.lexsort((high, low, distance))
        links = np.stack([low[order], high[order], distance[order]])
        links = links[:, np.concatenate(([True], (links[:, 1:] != links[:, :-1]).any(axis=0)))]
        forests = [Forest() for _ in range(self.forests)]
        keep = [any(f.add(a, b) for f in forests) for a, b in zip(links[0].tolist(), links[1].tolist(), strict=True)]
        self.parts = [links[:, np.array(keep)]]
        self.held = self.kept = sum(keep)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(smaller nodes, larger nodes)."""
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._reduce()
        return self.parts[0][0], self.parts[0][1]
