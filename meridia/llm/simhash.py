"""SimHash near-duplicates by multi-index hashing.

A fingerprint is 64 majority bits over the XXH64 hashes of a text's word shingles. Two
texts link if their fingerprints differ in at most two bits. Cut into two segments of 32
bits, such a pair either differs by at most one bit in the high segment, or agrees in the
low one. So the table holds every distinct fingerprint under both segments; a fingerprint
probes the high table with the ball of radius one around its segment (33 keys), the low
table with its own, and the full distance verifies what is found.

Segments that many fingerprints share (near copies of one text agree in half their bits)
are cut again by the same rule: what remains of the distance in the other segment is
searched by balls in its 16-bit halves. Buckets then hold fingerprints that agree in 48
bits, which bounds them, whatever the data. No link is lost on either way.

Only distinct fingerprints take part, so exact copies cost one row. Components come from
the links by alternating stars; a component's id is the least id of its documents.

Edited copies at a shingle similarity of 0.8 are far apart for 64 bits, so a second search,
``similar_texts``, joins the sets of five-word shingles by prefix filtering: with all sets in one
order of shingles, two of Jaccard similarity t share one among the first n - ceil(t n) + 1 of each
(n: the set's size), and what follows their first common one bounds what they share. So every
pair meets in the cell of a shingle, whatever the order; the order, frequent ones of a sample last,
only keeps cells small. What meets is held against 512 bits of both sets, with a limit beyond which
less than one in 10^8 pairs at the least similarity lies.

A crowd of copies has too many pairs to verify, so a task verifies a minimum spanning forest of
its links first, by bits that differ, and large cells are dealt to parts that meet within
themselves. Texts that links of at least the least similarity connect are one group then, and
only pairs of two groups are left: those of links that failed or were not verified, and those of
large cells that hold several groups. All groups that such pairs connect meet in blocks, where their
texts are compared set by set. No pair is left out but between texts that verified links connect.
The groups depend on the texts alone.

Edge cases: a null or empty text, or one of white space only, has fingerprint zero and
links like any other; fewer words than a shingle give one shingle of them all; null ids
keep their rows but never name a component unless all its ids are null; repeated rows
stay; an empty table gives an empty result. Added columns replace those of the same name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import PROBES, SMALL_RUN, STANDS, Forest, NearestLinks, deal, small_pairs, whole_blocks, with_columns
from .common import bounded_batches, join_unique, materialize, text_or_empty
from .components import connected_components, with_component_id

SEED = 42
#: Fingerprints in a bucket of one 32-bit segment above which it is cut again.
LARGE_BUCKET = 64
#: Ids of dropped documents up to which they are broadcast (some 16 bytes each).
BROADCAST_IDS = 1_000_000
#: The wide fingerprint's words of 64 bits.
WORDS = 8
#: Of the links a task finds, this many spanning forests are verified at first.
FORESTS = 1
#: Documents whose shingles are counted for the order of shingles, and frequent ones that it knows at most.
#: They decide how large cells get, not which pairs are found.
SAMPLE_DOCS, FREQUENT_SHINGLES = 10_000, 200_000
#: Room for rounding in bounds; what passes is compared exactly.
SLACK = 1e-6
SET = f"struct<d0:long, d1:long, size:int, {', '.join(f'w{k}:long' for k in range(WORDS))}, prefix:array<long>>"
_words = re.compile(rb"[^\x20\x09-\x0D]+").findall


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 of each shingle in order, repeats included; none without words."""
    words = _words(text.encode("utf-8", "surrogatepass").lower())
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(flat[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)


def _ones(h: np.ndarray) -> np.ndarray:
    """How many rows of words have each bit."""
    ones = np.zeros(64 * h.shape[1], np.int64)
    for at in range(0, len(h), 1 << 14):
        part = np.ascontiguousarray(h[at : at + (1 << 14)])
        ones += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return ones


def simhash64(text: str, shingle: int = 3) -> int:
    """The fingerprint as an unsigned number."""
    h = shingle_hashes(text, shingle)
    return int.from_bytes(np.packbits(2 * _ones(h[:, None]) > len(h), bitorder="little").tobytes(), "little")


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """Majority bits of a set of hashes, in words."""
    # Each word's hash is a mix of the shingle's (the finalizer of SplitMix64).
    with np.errstate(over="ignore"):
        x = h[:, None] + np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return np.packbits(2 * _ones(x) > len(h), bitorder="little").view(np.uint64)


def prefix(h: np.ndarray, frequent: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The first of a set of hashes, in an order that all sets share; a set that is as similar has one of them among its own.

    ``frequent``, in order, come last, by their counts.
    """
    if not len(h):
        return h
    count = np.zeros(len(h), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
        count = np.where(frequent[at] == h, counts[at], 0)
    return h[np.lexsort((h, count))[: len(h) - math.ceil(least * len(h) - SLACK) + 1]]


def simhash_column(text: Column, shingle: int = 3) -> Column:
    """The fingerprint as a signed long of the same bits."""

    @F.arrow_udf("long")
    def fingerprints(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([simhash64(t.as_py(), shingle) for t in texts], np.uint64).view(np.int64))

    return fingerprints(text)


def _bits(column: Column, width: int) -> list[Column]:
    """The ball of radius one around a segment of that width: itself and each bit flipped."""
    return [column, *[column.bitwiseXOR(F.lit(1 << i)) for i in range(width)]]


def _segment(name: str, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(F.col(name), shift).bitwiseAND(F.lit((1 << width) - 1)).cast("long")


def _keys(table: int, columns: list[Column]) -> Column:
    return F.transform(F.array(*columns), lambda k: F.struct(F.lit(table).alias("t"), k.alias("key")))


def _near() -> Column:
    return (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)


def fingerprint_links(fingerprints: DataFrame) -> DataFrame:
    """fp (distinct longs) -> (a, b) with at most two differing bits, some in both orders."""
    high, low = _segment("fp", 32, 32), _segment("fp", 0, 32)
    segments = fingerprints.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("t"), high.alias("key")), F.struct(F.lit(1).alias("t"), low.alias("key")))).alias("k")).select("fp", "k.t", "k.key")
    sizes = segments.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"))
    large = materialize(sizes.filter(F.col("n") > LARGE_BUCKET).select("t", "key"), "large")

    # Common buckets: one key for each segment, probes by ball in the high and exact in the low.
    probes = F.concat(_keys(0, _bits(high, 32)), _keys(1, [low]))
    left = fingerprints.select(F.col("fp").alias("a"), F.explode(probes).alias("k")).select("a", "k.t", "k.key")
    right = segments.join(large, ["t", "key"], "left_anti").withColumnRenamed("fp", "b")
    links = left.join(right, ["t", "key"]).filter(_near()).select("a", "b")
    if large.isEmpty():
        return links
    return links.unionByName(_links_in_large(fingerprints, segments, large))


def _links_in_large(fingerprints: DataFrame, segments: DataFrame, large: DataFrame) -> DataFrame:
    """The same links where the bucket of b is large, by keys of 48 bits.

    With high segments at distance d0 (0 or 1), the low ones differ by at most 2 - d0:
    d0 = 0: their high halves by at most one bit, or their low halves not at all;
    d0 = 1: one of their halves not at all. With equal low segments, likewise in the high.
    """

    def compound(key: Column, half: Column) -> Column:
        return F.shiftleft(key, 16).bitwiseOR(half)

    low_a, low_b = _segment("fp", 16, 16), _segment("fp", 0, 16)
    high_a, high_b = _segment("fp", 48, 16), _segment("fp", 32, 16)
    high, low = _segment("fp", 32, 32), _segment("fp", 0, 32)
    members = segments.join(large, ["t", "key"])
    right = members.select(
        F.col("fp").alias("b"),
        F.explode(
            F.when(F.col("t") == 0, F.array(F.struct(F.lit(0).alias("t"), compound(F.col("key"), low_a).alias("key")), F.struct(F.lit(1).alias("t"), compound(F.col("key"), low_b).alias("key")))).otherwise(
                F.array(F.struct(F.lit(2).alias("t"), compound(F.col("key"), high_a).alias("key")), F.struct(F.lit(3).alias("t"), compound(F.col("key"), high_b).alias("key")))
            )
        ).alias("k"),
    ).select("b", "k.t", "k.key")
    # Which buckets a fingerprint probes: those of its ball that are large.
    probed = fingerprints.select("fp", F.explode(F.concat(_keys(0, _bits(high, 32)), _keys(1, [low]))).alias("k")).select("fp", "k.t", "k.key").join(large, ["t", "key"])
    d0 = F.bit_count(F.col("key").bitwiseXOR(high))
    in_high = F.when(d0 == 0, F.concat(_keys(0, [compound(F.col("key"), x) for x in _bits(low_a, 16)]), _keys(1, [compound(F.col("key"), low_b)]))).otherwise(
        F.concat(_keys(0, [compound(F.col("key"), low_a)]), _keys(1, [compound(F.col("key"), low_b)]))
    )
    in_low = F.concat(_keys(2, [compound(F.col("key"), x) for x in _bits(high_a, 16)]), _keys(3, [compound(F.col("key"), high_b)]))
    left = probed.select(F.col("fp").alias("a"), F.explode(F.when(F.col("t") == 0, in_high).otherwise(in_low)).alias("k")).select("a", "k.t", "k.key")
    found = left.join(right, ["t", "key"])
    return found.filter(_near()).select("a", "b")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id, one row for each document."""
    bounded_batches(docs.sparkSession)
    hashed = materialize(docs.select(F.col(id_col).alias("doc_id"), simhash_column(text_or_empty(text_col), shingle).alias("fp")), "fingerprints")
    distinct = materialize(hashed.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")), "distinct")
    components = connected_components(fingerprint_links(distinct.select("fp")))
    labelled = distinct.join(components, distinct["fp"] == components["node"], "left").select("fp", "n", "least_id", F.coalesce("component", "fp").alias("component"))
    named = with_component_id(labelled).select("fp", "n", "component_id")
    return join_unique(hashed, named, ["fp"]).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def bit_limit(least: float) -> int:
    """Bits of the wide fingerprint by which sets of at least that similarity differ at most: six deviations
    from the mean of a pair at just that similarity, or of the smallest sets, whose ties differ more often."""
    n = math.ceil(least / (1 - least) - SLACK) if least < 1 else 0
    ties = math.comb(n, (n + 1) // 2) / 2 ** (n + 1) if 0 < n < 1000 else 0
    share = max(math.acos(2 * least / (1 + least)) / math.pi, ties)
    return math.ceil(64 * WORDS * share + 6 * math.sqrt(64 * WORDS * share * (1 - share)))


def _frequent_shingles(known: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, counts) of shingles that more than one text of a sample has."""

    @F.arrow_udf("array<long>")
    def shingles(texts: pa.Array) -> pa.Array:
        return pa.array([np.unique(shingle_hashes(t.as_py(), shingle)).view(np.int64) for t in texts], pa.list_(pa.int64()))

    every = -(-known.count() // SAMPLE_DOCS) or 1
    sample = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text", F.xxhash64("text").alias("h"))
    counts = sample.dropDuplicates(["h"]).select(F.explode(shingles("text")).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    top = counts.orderBy(F.col("n").desc(), "s").limit(FREQUENT_SHINGLES).toArrow()
    found = top["s"].to_numpy().view(np.uint64)
    order = found.argsort()
    return found[order], top["n"].to_numpy()[order]


def _alike(dealt: DataFrame, least: float) -> DataFrame:
    """(node, at): for each node its entries (t, cell, own) that meet a set which their sizes and places
    let be as similar. Cells that were cut keep all their entries and aren't ``own``."""
    share = least / (1 + least)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, ends in whole_blocks(batches):
            node, cut = table["node"].to_numpy(), table["j"].to_numpy() > 0
            size, left = table["size"].to_numpy(), table["left"].to_numpy()
            close = cut.copy()
            a, b = small_pairs(starts, ends, table["side"].to_numpy(), node)
            # They share no more than what the shorter rest from here holds.
            fit = np.minimum(left[a], left[b]) >= share * (size[a] + size[b]) - SLACK
            close[a[fit]] = close[b[fit]] = True
            for n in np.flatnonzero((ends - starts > SMALL_RUN) & ~cut[starts]).tolist():
                at = slice(starts[n], ends[n])
                fit = np.minimum(left[at][:, None], left[at]) >= share * (size[at][:, None] + size[at]) - SLACK
                np.fill_diagonal(fit, False)
                close[at] = fit.any(axis=1)
            if close.any():
                kept = table.select(["node", "t", "cell"]).append_column("own", pa.array(~cut))
                yield from kept.filter(pa.array(close)).to_batches()

    kept = dealt.mapInArrow(keep, "node long, t int, cell long, own boolean")
    return kept.groupBy("node").agg(F.collect_set(F.struct("t", "cell", "own")).alias("at"))


def _near_links(dealt: DataFrame, wide: int, forests: int) -> DataFrame:
    """(a, b), a < b: of the links of at most ``wide`` bits in each partition's blocks, that many spanning forests.

    Where nodes come with a ``group``, the links are those of groups.
    """
    name = "group" if "group" in dealt.columns else "node"

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = NearestLinks(forests)
        for table, starts, ends in whole_blocks(batches):
            side, node = table["side"].to_numpy(), table[name].to_numpy()
            words = [table[f"w{k}"].to_numpy().view(np.uint64) for k in range(WORDS)]
            a, b = small_pairs(starts, ends, side, node)
            distance = sum(np.bitwise_count(w[a] ^ w[b]).astype(np.int16) for w in words)
            near = distance <= wide
            found.add(node[a[near]], node[b[near]], distance[near])
            for n in np.flatnonzero(ends - starts > SMALL_RUN).tolist():
                at = np.arange(starts[n], ends[n])
                a, b = at[side[at] != PROBES], at[side[at] != STANDS]
                if len(a) and len(b):
                    distance = sum(np.bitwise_count(w[a][:, None] ^ w[b]).astype(np.int16) for w in words)
                    x, y = np.nonzero((distance <= wide) & (node[a][:, None] != node[b]))
                    found.add(node[a[x]], node[b[y]], distance[x, y])
        low, high = found.links()
        if len(low):
            yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["a", "b"])

    return dealt.mapInArrow(verify, "a long, b long").distinct()


def _similar_enough(links: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The links whose shingle sets (node, shingles) have at least that Jaccard similarity."""
    left, right = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set")) for c in ("a", "b"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    return links.join(left, "a").join(right, "b").filter(both >= least * (F.size("a_set") + F.size("b_set") - both)).select("a", "b")


def _with_main(members: DataFrame, of: list[str]) -> DataFrame:
    """members (of, node, group) as entries: those of the largest group of each cell don't stand in it. Cells of one group go."""
    groups = members.groupBy(*of, "group").agg(F.count(F.lit(1)).alias("n"))
    main = groups.groupBy(*of).agg(F.max(F.struct("n", "group")).alias("main"), F.count(F.lit(1)).alias("groups")).filter("groups > 1")
    return members.join(main, of).withColumn("own", F.col("group") != F.col("main.group")).drop("main", "groups")


def _linked_groups(dealt: DataFrame, wide: int, least: float) -> DataFrame:
    """(a, b): links of groups that are as similar in some pair of their sets; in each partition, a spanning forest of them."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for table, starts, ends in whole_blocks(batches):
            side, group, sets = table["side"].to_numpy(), table["group"].to_numpy(), table["shingles"].combine_chunks()
            size = sets.value_lengths().to_numpy()
            words = [table[f"w{k}"].to_numpy().view(np.uint64) for k in range(WORDS)]
            for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
                at = np.arange(start, end)
                a, b = at[side[at] != PROBES], at[side[at] != STANDS]
                distance = sum(np.bitwise_count(w[a][:, None] ^ w[b]).astype(np.int16) for w in words)
                fit = np.minimum(size[a][:, None], size[b]) >= least * np.maximum(size[a][:, None], size[b]) - SLACK
                x, y = np.nonzero((distance <= wide) & fit & (group[a][:, None] != group[b]))
                # Nearest first: groups that are linked already need no more links.
                order = distance[x, y].argsort(kind="stable")
                for m, n in zip(a[x[order]].tolist(), b[y[order]].tolist(), strict=True):
                    low, high = sorted((int(group[m]), int(group[n])))
                    if not forest.joins(low, high):
                        both = len(np.intersect1d(sets[m].values.to_numpy(), sets[n].values.to_numpy(), assume_unique=True))
                        if both >= least * (int(size[m]) + int(size[n]) - both):
                            forest.add(low, high)
        if forest.edges:
            low, high = zip(*forest.edges, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(verify, "a long, b long").distinct()


def _links_between(nodes: DataFrame, links: DataFrame, verified: DataFrame, cut: DataFrame, sets: DataFrame, wide: int, least: float) -> DataFrame | None:
    """Links of groups that the verified ones don't connect; None if there are none to look for.

    ``links``: those verified or failed; ``cut``: t, cell and node of cells that didn't meet as a whole.
    """
    names = [f"w{k}" for k in range(WORDS)]
    groups = materialize(connected_components(verified).withColumnRenamed("component", "group"), "groups")
    group_of = lambda df, c, g: df.join(groups.select(F.col("node").alias(c), F.col("group").alias("_g")), c, "left").withColumn(g, F.coalesce("_g", c)).drop("_g")
    open_ = group_of(group_of(links, "a", "ga"), "b", "gb").filter("ga <> gb").select(F.col("ga").alias("a"), F.col("gb").alias("b"))
    if not cut.isEmpty():
        entries = materialize(_with_main(group_of(cut, "node", "group"), ["t", "cell"]), "cut")
        crossing = _near_links(deal(entries.join(nodes.select("node", *names), "node")), wide, FORESTS)
        open_ = open_.unionByName(crossing)
    open_ = materialize(open_.distinct(), "open")
    if open_.isEmpty():
        return None
    # All groups that open links connect meet, each set once with the few that stand.
    met = connected_components(open_).select(F.col("node").alias("group"), F.col("component").alias("cell"))
    members = group_of(sets.select("node"), "node", "group").join(met, "group")
    entries = materialize(_with_main(members.withColumn("t", F.lit(0)), ["t", "cell"]), "meeting")
    whole = entries.join(nodes.select("node", *names), "node").join(sets, "node")
    return materialize(_linked_groups(deal(whole), wide, least), "between")


def similar_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id, component_id of all documents with ids: groups that links of at least that similarity connect."""
    bounded_batches(docs.sparkSession)
    names, digest = [f"w{k}" for k in range(WORDS)], ["d0", "d1"]
    known = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    frequent, counts = _frequent_shingles(known, shingle)

    @F.arrow_udf(SET)
    def described(texts: pa.Array) -> pa.Array:
        sets = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in texts]
        digests = np.frombuffer(b"".join(xxhash.xxh128_digest(h.tobytes(), SEED) for h in sets), np.int64).reshape(-1, 2)
        words = np.array([wide_fingerprint(h) for h in sets], np.uint64).reshape(-1, WORDS).view(np.int64)
        prefixes = pa.array([prefix(h, frequent, counts, least).view(np.int64) for h in sets], pa.list_(pa.int64()))
        columns = [*[pa.array(digests[:, k]) for k in range(2)], pa.array([len(h) for h in sets], pa.int32()), *[pa.array(words[:, k]) for k in range(WORDS)], prefixes]
        return pa.StructArray.from_arrays(columns, names=[*digest, "size", *names, "prefix"])

    @F.arrow_udf("array<long>")
    def shingles(texts: pa.Array) -> pa.Array:
        return pa.array([np.unique(shingle_hashes(t.as_py(), shingle)).view(np.int64) for t in texts], pa.list_(pa.int64()))

    hashed = materialize(known.select("doc_id", F.xxhash64("text").alias("h"), described("text").alias("f")).select("doc_id", "h", "f.*"), "wide")
    distinct = hashed.groupBy(*digest).agg(F.min(F.struct("doc_id", "h", "size", *names, "prefix")).alias("first"), F.count(F.lit(1)).alias("n"))
    # Numbered in an order that the sets alone give, so that reruns number alike: nodes decide ties and parts of cells.
    ordered = distinct.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *digest).sortWithinPartitions(*digest)
    nodes = materialize(
        ordered.select(F.monotonically_increasing_id().alias("node"), *digest, "n", F.col("first.doc_id").alias("least_id"), *[f"first.{c}" for c in ("h", "size", *names, "prefix")]), "nodes"
    )
    entries = nodes.select("node", "size", F.posexplode("prefix").alias("place", "cell")).select("node", F.lit(0).alias("t"), "cell", F.lit(True).alias("own"), "size", (F.col("size") - F.col("place")).alias("left"))
    close = materialize(_alike(deal(entries, grid=False), least), "close")
    wide = bit_limit(least)
    # What follows takes all entries as standing; those of cut cells are known by ``whole``.
    met = with_columns(close, nodes.select("node", *names)).withColumnRenamed("own", "whole").withColumn("own", F.lit(True))
    links = materialize(_near_links(deal(met.drop("whole"), grid=False), wide, FORESTS), "near")
    cut = materialize(close.select("node", F.explode("at").alias("e")).filter("not e.own").select("e.t", "e.cell", "node"), "cut-cells")
    # Shingle sets of one document for each node that has a link or is in a cell that was cut.
    linked = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).unionByName(cut.select("node")).distinct()
    wanted = materialize(nodes.join(linked, "node", "left_semi").select("node", F.col("least_id").alias("doc_id"), "h"), "wanted")
    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    first = known.withColumn("h", F.xxhash64("text")).join(F.broadcast(wanted) if few else wanted, ["doc_id", "h"])
    sets = materialize(first.select("node", shingles("text").alias("shingles")).dropDuplicates(["node"]), "sets")
    verified = materialize(_similar_enough(links, sets, least), "verified")
    between = _links_between(nodes, links, verified, cut, sets, wide, least)
    components = connected_components(verified if between is None else verified.unionByName(between))
    labelled = nodes.join(components, "node", "left").select(*digest, "n", "least_id", F.coalesce("component", "node").alias("component"))
    named = with_component_id(labelled).select(*digest, "n", "component_id")
    return join_unique(hashed.select("doc_id", *digest), named, digest).select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """The input's rows whose id names their group: one document of each stays. Null ids stay."""
    found = similar_texts(docs, id_col=id_col, text_col=text_col, shingle=shingle, least=least)
    # Those that go are fewer than those that stay; while they are few, no text is shuffled.
    names = found.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("names"))
    gone = materialize(names.filter("not names").select(F.col("doc_id").alias("_gone_id")), "gone")
    gone = F.broadcast(gone) if gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else gone
    return docs.join(gone, docs[id_col] == F.col("_gone_id"), "left_anti").select(docs.columns)
