"""Connected components of a graph of 64-bit nodes, by alternating stars.

Each round replaces every node's links by links to the least node it sees, first among
larger neighbours, then among smaller ones (the large-star and small-star operations of
Kiveris et al., "Connected Components in MapReduce and Beyond", 2014). The graph keeps its
components, never grows, and ends as one star for each, after a number of rounds that is
logarithmic in practice. Rounds are written to the shared folder, so none is lost with an
executor; nothing but a count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_unique, materialize


def _towards_least(links: DataFrame) -> DataFrame:
    """links (a, b), one direction each -> (a, least of a and its neighbours) for all a."""
    return links.groupBy("a").agg(F.min("b").alias("least"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the least node reachable. Nodes without links are absent."""
    larger, smaller = F.greatest(a, b).alias("a"), F.least(a, b).alias("b")
    links = materialize(edges.select(larger, smaller).filter("a <> b").distinct(), "links")
    state = None
    while True:
        # Large star: every larger neighbour of a node links to the least it sees.
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _towards_least(both).withColumn("least", F.least("least", "a"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        # Small star: smaller neighbours and the node itself link to the least of them.
        least = _towards_least(large)
        joined = large.join(least, "a")
        small = joined.filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b"))).distinct()
        links = materialize(small, "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())


def with_component_id(labelled: DataFrame) -> DataFrame:
    """labelled (component, least_id, ...) with component_id, the least of its component's ids; written out."""
    labelled = materialize(labelled, "labelled")
    ids = materialize(labelled.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("members")), "ids")
    return materialize(join_unique(labelled, ids, ["component"], "members"), "named")
