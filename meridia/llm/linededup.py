"""Line dedup by site-relative frequency, in DataFrame operations only.

A line's ratio is the number of a host's pages that contain it, divided by the number of
the host's pages. Lines with a ratio above ``most_ratio`` on at least ``least_pages``
pages are boilerplate of that host and are dropped from all its pages.

Lines are compared trimmed and count once a page; they travel as a 64-bit hash and their
length. Counting is pre-aggregated before the shuffle, so a hot host or line adds a row
for each task and no more.

Boilerplate lines of a host go to its pages as a small hash table where they are few, so a
line costs one look whatever their number. Pages of hosts with many, and all pages if the
lines of all hosts are too many to broadcast, are taken apart instead, joined by host and
line, and put together again: no step is more than linear in the text.

Two lines of a host are taken for one if both their 64-bit hashes and lengths agree: for a
host with a million different lines of one length, by chance once in 30 million hosts.

Edge cases: a null text stays null and has no lines; empty lines are never boilerplate
and always stay; a null host is a host of its own; pages whose lines all go keep the
empty text; repeated rows count as pages of their own; an empty table gives an empty
result. Other columns pass through, the text is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Boilerplate lines, over all hosts, up to which they are broadcast (some 60 bytes each).
BROADCAST_LINES = 200_000
#: Boilerplate lines of a host up to which each of its pages gets them all.
HOST_LINES = 512
#: Parts of a hot line's pages when pages are taken apart.
LINE_PARTS = 16
ADDED = ["_kept_text", "_n_dropped"]


def line_key(line: Column) -> Column:
    trimmed = F.trim(line)
    return F.struct(F.xxhash64(trimmed).alias("h"), F.length(trimmed).alias("n"))


def boilerplate_lines(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", most_ratio: float = 0.05, least_pages: int = 3) -> DataFrame:
    """host, key, pages, host_pages of the lines to drop."""
    host = docs[host_col].alias("host")
    totals = docs.groupBy(host).agg(F.count(F.lit(1)).alias("host_pages"))
    # A host's number of lines above the ratio is at most its lines a page over the ratio.
    lines = F.filter(F.split(docs[text_col], "\n", -1), lambda x: F.trim(x) != "")
    keys = docs.select(host, F.explode(F.array_distinct(F.transform(lines, line_key))).alias("key"))
    counts = keys.groupBy("host", "key").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= least_pages)
    joined = counts.join(F.broadcast(totals) if _few(totals) else totals, counts["host"].eqNullSafe(totals["host"]))
    return joined.filter(F.col("pages") > F.col("host_pages") * F.lit(most_ratio)).select(counts["host"], "key", "pages", "host_pages")


def _few(df: DataFrame) -> bool:
    return df.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES


def drop_boilerplate(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", most_ratio: float = 0.05, least_pages: int = 3, broadcast_lines: int = BROADCAST_LINES, counts: bool = False) -> DataFrame:
    """The input with boilerplate lines dropped; counts adds n_lines and n_dropped."""
    drop = materialize(boilerplate_lines(docs, text_col=text_col, host_col=host_col, most_ratio=most_ratio, least_pages=least_pages), "lines")
    if drop.limit(broadcast_lines + 1).count() > broadcast_lines:
        out = _by_page(docs, drop, text_col, host_col)
    else:
        # At most one host for each HOST_LINES of the lines that are few enough to broadcast.
        rich = materialize(drop.groupBy("host").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOST_LINES).select(F.col("host").alias("_rich_host")), "rich")
        if rich.isEmpty():
            out = _by_host(docs, drop, text_col, host_col)
        else:
            of_rich = docs[host_col].eqNullSafe(F.col("_rich_host"))
            poor = drop.join(F.broadcast(rich), drop["host"].eqNullSafe(F.col("_rich_host")), "left_anti")
            out = _by_host(docs.join(F.broadcast(rich), of_rich, "left_anti"), poor, text_col, host_col).unionByName(_by_page(docs.join(F.broadcast(rich), of_rich, "left_semi"), drop, text_col, host_col))
    names = [F.when(F.col(text_col).isNotNull(), F.col("_kept_text")).alias(c) if c == text_col else F.col(c) for c in docs.columns if not (counts and c in ("n_lines", "n_dropped"))]
    if counts:
        known = lambda n: F.when(F.col(text_col).isNull(), 0).otherwise(n).cast("long")
        names += [known(F.size(F.split(F.col(text_col), "\n", -1))).alias("n_lines"), known(F.col("_n_dropped")).alias("n_dropped")]
    return out.select(*names)


def _bucket(h: Column, size: Column) -> Column:
    return F.pmod(h, size).cast("int")


def _by_host(docs: DataFrame, drop: DataFrame, text_col: str, host_col: str) -> DataFrame:
    """Few lines in all: each host's hash table is broadcast, no text moves."""
    # As many buckets as lines at least, in an array that is read by position.
    sizes = drop.groupBy("host").agg(F.pow(F.lit(2), F.ceil(F.log2(F.count(F.lit(1))))).cast("int").alias("size"))
    numbers = sizes.select(F.col("host").alias("_of"), "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("bucket"))
    keys = drop.join(sizes.withColumnRenamed("host", "_of"), drop["host"].eqNullSafe(F.col("_of"))).groupBy(F.col("_of").alias("_in"), _bucket(F.col("key.h"), F.col("size")).alias("at")).agg(F.collect_list("key").alias("keys"))
    table = numbers.join(keys, F.col("_of").eqNullSafe(F.col("_in")) & (F.col("bucket") == F.col("at")), "left").groupBy(F.col("_of").alias("_drop_host"))
    table = table.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", F.coalesce("keys", F.array().cast("array<struct<h:bigint,n:int>>")).alias("keys")))), lambda x: x["keys"]).alias("_table"))
    joined = docs.join(F.broadcast(table), docs[host_col].eqNullSafe(F.col("_drop_host")), "left")

    def stays(line: Column) -> Column:
        key = line_key(line)
        return ~F.coalesce(F.array_contains(F.get(F.col("_table"), _bucket(key["h"], F.size("_table"))), key), F.lit(False))

    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.when(F.col("_table").isNotNull(), F.filter(lines, stays))
    marked = joined.withColumn("_stay", kept)
    return marked.withColumn("_kept_text", F.coalesce(F.array_join("_stay", "\n"), F.col(text_col))).withColumn("_n_dropped", F.coalesce(F.size(lines) - F.size(F.when(F.col("_stay").isNotNull(), F.col("_stay")).otherwise(lines)), F.lit(0))).select(*docs.columns, *ADDED)


def _by_page(docs: DataFrame, drop: DataFrame, text_col: str, host_col: str) -> DataFrame:
    """Many lines: different pages are taken apart, joined on host and line, and put together.

    Pages are identified by hashes of host and text: pages that agree in both lose the same
    lines, so repeated rows need no id of their own.
    """
    page = F.struct(F.xxhash64(F.col(host_col), F.col(text_col)).alias("h"), F.length(text_col).alias("n"), F.hash(F.col(text_col), F.col(host_col)).alias("g"))
    keyed = docs.withColumn("_page", page)
    pages = keyed.filter(F.col(text_col).isNotNull()).select("_page", F.col(host_col).alias("_line_host"), F.col(text_col).alias("_text")).dropDuplicates(["_page"])
    lines = pages.select("_page", "_line_host", F.posexplode(F.split("_text", "\n", -1)).alias("_at", "_line")).withColumn("_key", line_key(F.col("_line"))).withColumn("_part", F.pmod(F.col("_page.h"), F.lit(LINE_PARTS)).cast("int"))
    parts = drop.select("host", "key", F.explode(F.sequence(F.lit(0), F.lit(LINE_PARTS - 1))).alias("part"))
    joined = lines.join(parts, lines["_line_host"].eqNullSafe(parts["host"]) & (lines["_key"] == parts["key"]) & (lines["_part"] == parts["part"]), "left")
    dropped = F.col("part").isNotNull()
    kept = joined.groupBy(F.col("_page").alias("_of")).agg(F.array_sort(F.collect_list(F.when(~dropped, F.struct("_at", "_line")))).alias("_stay"), F.sum(dropped.cast("int")).alias("_n_dropped"))
    kept = kept.select("_of", F.array_join(F.transform("_stay", lambda x: x["_line"]), "\n").alias("_kept_text"), "_n_dropped")
    return keyed.join(kept, F.col("_page") == F.col("_of"), "left").select(*docs.columns, *ADDED)
