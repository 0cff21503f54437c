"""Embedding near-duplicates by E8 lattice hashing.

Unit vectors are projected at random to BLOCKS x 8 dimensions in each of TABLES tables and
every block is decoded to its nearest E8 lattice point; the points together are the cell.
A vector stands in its own cell and probes the cells next to it: for each block, the
lattice neighbours its projection leans to most. Pairs that meet in a cell are verified by
cosine in double precision.

Tables and blocks follow from the number of vectors (``PLANS``): more blocks make smaller
cells, so that a vector meets some 2,000 strangers at most, and more tables keep the recall.
A first pass over 128-bit sign sketches drops the entries of a cell that resemble no other
entry there, before any vector travels; of a million strangers one passes.

Cells are compared in blocks of bounded size, so none is gathered anywhere. A vector's cells are computed once and travel with it as a short
code. By them both sides can tell the first table in which a pair meets, where alone it
counts; a task returns link counts and spanning forests, not all pairs.

Equal vectors are one node with a weight, numbered when the nodes are written. Measured
recall is in the README and tests.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and
rows with null ids, link with nothing: n_links 0, component_id their own id, kept true (for
null ids: component_id null, kept false). Vectors of unequal length never link. Rows are
vectors of their own even where they share an id: each has its own links and component, and
equal vectors link as any others do. Ids are read as 64-bit integers; others raise. An
empty table gives an empty result. Columns other than the id and the vector are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import PROBES, SMALL_RUN, STANDS, Forest, deal, resembling, small_pairs, whole_blocks, with_columns
from .common import bounded_batches, join_unique, materialize
from .components import connected_components, with_component_id

#: (vectors up to which it serves, tables, blocks): two vectors at cosine 0.9 meet in some table with probability 0.96.
PLANS = [(2_000_000, 10, 2), (70_000_000, 29, 3), (1 << 62, 77, 4)]
NEIGHBOURS = 2
#: Width of the lattice in standard deviations of a projected unit vector.
WIDTH = 2.0
#: Sketches of vectors at cosine 0.9 differ in 18 of 128 bits on average, in more than 37 about once in a million pairs.
SKETCH_BITS = 37


def e8_roots() -> np.ndarray:
    """The 240 shortest vectors: (+-1, +-1, 0...) and (+-1/2...) with an even number of minus signs."""
    roots = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            roots.append(v)
    roots += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(roots)


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer point with an even sum: where the sum is odd, the worst rounding goes the other way."""
    near = np.round(x)
    error = x - near
    worst = np.abs(error).argmax(-1)[..., None]
    odd = near.sum(-1, keepdims=True) % 2 != 0
    step = np.where(np.take_along_axis(error, worst, -1) >= 0, 1.0, -1.0)
    np.put_along_axis(near, worst, np.take_along_axis(near, worst, -1) + np.where(odd, step, 0.0), -1)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8, the union of D8 and D8 shifted by one half."""
    whole, half = _d8(x), _d8(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(-1) <= ((x - half) ** 2).sum(-1)
    return np.where(closer[..., None], whole, half)


def lattice_plan(vectors: int) -> tuple[int, int]:
    """(tables, blocks) for that many vectors."""
    return next((tables, blocks) for most, tables, blocks in PLANS if vectors <= most)


class Lattice:
    """Cells of unit vectors of one length."""

    def __init__(self, dimensions: int, tables: int, blocks: int, seed: int = 42, neighbours: int = NEIGHBOURS, width: float = WIDTH):
        rng = np.random.default_rng([seed, dimensions])
        self.shape = (tables, blocks, 8)
        self.project = rng.normal(size=(dimensions, tables * blocks * 8)) / width
        self.planes = rng.normal(size=(dimensions, 128))
        mix = rng.integers(1, 1 << 62, size=(blocks, 8), dtype=np.int64) * 2 + 1
        self.salt = rng.integers(-(1 << 62), 1 << 62, size=tables, dtype=np.int64)
        self.roots, self.neighbours, self.mix = e8_roots(), neighbours, mix
        with np.errstate(over="ignore"):
            self.moves = (2 * self.roots).astype(np.int64) @ mix.T  # roots x blocks

    def codes(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, tables) hashes of the own cells, (rows, tables, blocks, neighbours) roots towards those probed."""
        # einsum and not a matrix product: a vector's cells must not depend on the batch it is in.
        y = np.einsum("nd,dk->nk", unit, self.project).reshape(len(unit), *self.shape)
        points = nearest_e8(y)
        lean = np.einsum("ntbd,rd->ntbr", y - points, self.roots)
        order = np.empty((*lean.shape[:-1], self.neighbours), np.uint8)
        for k in range(self.neighbours):
            best = lean.argmax(axis=-1)
            order[..., k] = best
            np.put_along_axis(lean, best[..., None], -np.inf, -1)
        with np.errstate(over="ignore"):
            return self.salt + ((2 * points).astype(np.int64) * self.mix).sum(axis=(2, 3)), order

    def cells(self, own: np.ndarray, order: np.ndarray) -> np.ndarray:
        """(rows, tables, 1 + blocks x neighbours) hashes: the own cell, then those probed."""
        # A cell's hash is linear in its doubled coordinates, so a neighbour's is a sum.
        with np.errstate(over="ignore"):
            probed = [own[:, :, None] + self.moves[order[:, :, b], b] for b in range(self.shape[1])]
        return np.concatenate([own[:, :, None], *probed], axis=2)

    def pack(self, own: np.ndarray, order: np.ndarray) -> list[bytes]:
        return [a.tobytes() + b.tobytes() for a, b in zip(own, order, strict=True)]

    def unpack(self, packed: list[bytes]) -> np.ndarray:
        """Cells from packed codes."""
        tables, blocks, _ = self.shape
        raw = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), tables * (8 + blocks * self.neighbours))
        own = np.ascontiguousarray(raw[:, : 8 * tables]).view(np.int64)
        return self.cells(own, raw[:, 8 * tables :].reshape(-1, tables, blocks, self.neighbours))

    def sketches(self, unit: np.ndarray) -> np.ndarray:
        """(rows, 2) words of sign bits."""
        return np.packbits(np.einsum("nd,dk->nk", unit, self.planes) > 0, axis=1).view(np.int64)


@lru_cache(maxsize=8)
def _lattice(dimensions: int, tables: int, blocks: int, seed: int) -> Lattice:
    return Lattice(dimensions, tables, blocks, seed)


def units(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, their unit vectors) for each length that occurs."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(sizes)
    out = []
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        out.append((rows, units(flat[(ends[rows] - n)[:, None] + np.arange(n)])))
    return out


def _indexed(nodes: DataFrame, plan: tuple[int, int], seed: int) -> DataFrame:
    """Nodes with the code of their cells and their sketch."""
    kind = nodes.schema["vector"].dataType.simpleString()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, sketch = np.empty(len(batch), object), np.empty((len(batch), 2), np.int64)
            for rows, unit in _matrix(batch.column("vector")):
                lattice = _lattice(unit.shape[1], *plan, seed)
                for at in range(0, len(rows), 512):
                    part = slice(at, at + 512)
                    code[rows[part]] = lattice.pack(*lattice.codes(unit[part]))
                    sketch[rows[part]] = lattice.sketches(unit[part])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code, pa.binary()), pa.array(sketch[:, 0]), pa.array(sketch[:, 1])], names=[*batch.schema.names, "code", "s1", "s2"])

    return nodes.mapInArrow(index, f"h1 long, h2 long, least_id long, weight long, vector {kind}, dim int, code binary, s1 long, s2 long")


def _entries(nodes: DataFrame, plan: tuple[int, int], seed: int) -> DataFrame:
    """node, t, cell, own (stands there or only probes), sketch."""

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                for at in range(0, int((dims == dim).sum()), 2048):
                    rows = np.flatnonzero(dims == dim)[at : at + 2048]
                    part = batch.take(pa.array(rows))
                    cells = _lattice(dim, *plan, seed).unpack(part.column("code").to_pylist())
                    n, tables, probes = cells.shape
                    wide = lambda c: pa.array(np.repeat(part.column(c).to_numpy(), tables * probes))  # noqa: B023, E731
                    t = pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), probes), n))
                    yield pa.RecordBatch.from_arrays([wide("node"), t, pa.array(cells.reshape(-1)), pa.array(np.tile(np.arange(probes) == 0, n * tables)), wide("s1"), wide("s2")], names=["node", "t", "cell", "own", "s1", "s2"])

    return nodes.select("node", "dim", "code", "s1", "s2").mapInArrow(enter, "node long, t int, cell long, own boolean, s1 long, s2 long")


def _verified(dealt: DataFrame, plan: tuple[int, int], least: float, seed: int) -> DataFrame:
    """(node, links, other): link counts where other is null, else edges of a spanning forest."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, ends in whole_blocks(batches):
            side, node, weight, t = (table[c].to_numpy() for c in ("side", "node", "weight", "t"))
            links, forest = np.zeros(len(table), np.int64), Forest()
            pair_a, pair_b = small_pairs(starts, ends, side, node)
            for rows, unit in _matrix(table["vector"].combine_chunks()):
                lattice = _lattice(unit.shape[1], *plan, seed)
                cells = lattice.unpack(table["code"].take(pa.array(rows)).to_pylist())
                place = np.full(len(table), -1)
                place[rows] = np.arange(len(rows))
                same = (place[pair_a] >= 0) & (place[pair_b] >= 0)
                low, high = pair_a[same], pair_b[same]
                low, high = np.where(node[low] < node[high], low, high), np.where(node[low] < node[high], high, low)
                for at in range(0, len(low), 4096):
                    a, b = low[at : at + 4096], high[at : at + 4096]
                    link = np.einsum("nd,nd->n", unit[place[a]], unit[place[b]]) >= least
                    a, b = a[link], b[link]
                    new = _first_meeting(cells[place[a]], cells[place[b]], t[a], side[a] != PROBES)
                    a, b = a[new], b[new]
                    np.add.at(links, a, weight[b])
                    np.add.at(links, b, weight[a])
                    for x, y in zip(node[a].tolist(), node[b].tolist(), strict=True):
                        forest.add(x, y)
                for n in np.flatnonzero(ends - starts > SMALL_RUN).tolist():
                    at = np.arange(starts[n], ends[n])
                    at = at[place[at] >= 0]
                    a, b = at[side[at] != PROBES], at[side[at] != STANDS]
                    link = (unit[place[a]] @ unit[place[b]].T >= least) & (node[a][:, None] != node[b])
                    a, b, link = a[some := link.any(axis=1)], b[some_b := link.any(axis=0)], link[some][:, some_b]
                    if len(a):
                        link &= ~_met_before(cells[place[a]], cells[place[b]], node[a], node[b], int(t[a[0]]))
                        np.add.at(links, a, link @ weight[b])
                        np.add.at(links, b, weight[a] @ link)
                        for rows_, columns in _forest(link):
                            centre = int(node[a[rows_[0]]])
                            for other in [*node[a[rows_]].tolist(), *node[b[columns]].tolist()]:
                                forest.add(centre, other)
            at = np.flatnonzero(links)
            edge_a, edge_b = zip(*forest.edges, strict=True) if forest.edges else ((), ())
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*node[at].tolist(), *edge_a], pa.int64()), pa.array([*links[at].tolist(), *[0] * len(edge_a)], pa.int64()), pa.array([*[None] * len(at), *edge_b], pa.int64())], names=["node", "links", "other"]
                )

    return dealt.mapInArrow(verify, "node long, links long, other long")


def _first_meeting(low: np.ndarray, high: np.ndarray, t: np.ndarray, low_stands: np.ndarray) -> np.ndarray:
    """Whether pairs (smaller node, larger node) that are in a block of table t together count there.

    They count in the first table in which one's own cell is among the other's, and there
    where the smaller stands if the larger has its cell, else where the larger stands.
    """
    meet = (low[:, :, :1] == high).any(axis=2)
    either = meet | (high[:, :, :1] == low).any(axis=2)
    return (either.argmax(axis=1) == t) & (low_stands | ~meet[np.arange(len(t)), t])


def _met_before(a: np.ndarray, b: np.ndarray, node_a: np.ndarray, node_b: np.ndarray, t: int) -> np.ndarray:
    """The same for all pairs of a that stands and b that probes in a cell of table t: whether they count elsewhere."""

    def stands(own: np.ndarray, probes: np.ndarray, s: int) -> np.ndarray:
        found = np.zeros((len(own), len(probes)), np.bool_)
        for k in range(probes.shape[2]):
            found |= own[:, s, 0][:, None] == probes[:, s, k]
        return found

    met = np.zeros((len(a), len(b)), np.bool_)
    for s in range(t):
        met |= stands(a, b, s) | stands(b, a, s).T
    return met | (stands(b, a, t).T & (node_a[:, None] > node_b))


def _forest(link: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, columns) of each component that the matrix's links make."""
    left = link.any(axis=1)
    while left.any():
        rows, size = np.zeros(len(link), np.bool_), 0
        rows[left.argmax()] = True
        while rows.sum() != size:
            size = rows.sum()
            columns = link[rows].any(axis=0)
            rows = link[:, columns].any(axis=1)
        left &= ~rows
        yield np.flatnonzero(rows), np.flatnonzero(columns)


def near_duplicate_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, seed: int = 42, plan: tuple[int, int] | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept, one row for each vector. plan: (tables, blocks), by PLANS if not given."""
    bounded_batches(vectors.sparkSession)
    plan = plan or lattice_plan(vectors.count())
    v = F.col(vector_col)
    fine = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(F.coalesce(fine, F.lit(False)), v).alias("vector"))
    # 128 bits stand for a vector where equal ones are found, so that none is shuffled for it.
    hashed = rows.select("vec_id", "vector", F.when(F.col("vector").isNotNull(), F.xxhash64("vector")).alias("h1"), F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit(seed), "vector")).alias("h2"))
    distinct = hashed.filter("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("weight"), F.first("vector").alias("vector")).withColumn("dim", F.size("vector"))
    nodes = materialize(_indexed(distinct, plan, seed).withColumn("node", F.monotonically_increasing_id()), "nodes")
    close = materialize(resembling(deal(_entries(nodes, plan, seed)), ["s1", "s2"], SKETCH_BITS), "close")
    with_vectors = with_columns(close, nodes.select("node", "weight", "code", "vector"))
    verified = materialize(_verified(deal(with_vectors), plan, least, seed), "verified")
    links = verified.filter("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    components = connected_components(verified.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    per_node = nodes.select("h1", "h2", "node", "least_id", "weight").join(links, "node", "left").join(components, "node", "left")
    per_node = per_node.select("h1", "h2", "weight", "least_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "node").alias("component"))
    named = with_component_id(per_node).select("h1", "h2", "weight", "links", "component_id")
    ids = materialize(hashed.select("vec_id", "h1", "h2"), "ids")
    of_nodes = join_unique(ids.filter("h1 is not null"), named, ["h1", "h2"], "weight").select("vec_id", "links", "component_id")
    without = ids.filter("h1 is null").select("vec_id", F.lit(None).cast("long").alias("links"), F.lit(None).cast("long").alias("component_id"))
    return of_nodes.unionByName(without).select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept")
    )
