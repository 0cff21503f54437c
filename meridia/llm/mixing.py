"""Mixing sources to target weights, in DataFrame operations only.

Documents of a source get hash-random keys; the source is range-partitioned by key and
sorted, distributed prefix sums of word counts find where its budget ends, and a source
whose budget exceeds its size is repeated in whole epochs. The cut falls at the document
boundary nearest to the exact budget, as texts are never truncated.

A key is made of the id and the whole text, so rows that share an id, or have none, have
places of their own. Rows equal in both are counted before anything is dealt by key, and
the cut may fall between them.

Edge cases: a null text has size 0; a null source is a source of its own, last in the
order of weights; of rows with equal ids and texts (repeated rows) as many as fit are
taken once more than the others; an empty table gives an empty result, and if all sizes
are 0 all targets are 0. Added columns replace input columns of the same name. The mix
compares repeated rows by all their columns, which must be of comparable types.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, text_or_empty

#: Key ranges of a source: hexadecimal digits of the key that number them.
RANGE_DIGITS = 3
#: Equal rows that one task writes.
CHUNK_ROWS = 100_000
#: Sources up to which their table is broadcast (some 100 bytes each).
BROADCAST_SOURCES = 200_000


def words(text_col: str) -> Column:
    return F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], most_epochs: int) -> DataFrame:
    """(source_key, source_size) -> also target: shares by weight, none above most_epochs sizes.

    The resharing of excess has a closed form: sources in order of size over weight reach
    their limit one after the other, and the rest share what is left by weight.
    """
    in_order = Window.orderBy("source_key")
    every = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", "source_key").rowsBetween(Window.unboundedPreceding, -1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    limit = (
        sizes.withColumn("weight", F.get(cycle, F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights)))))
        .withColumn("most", F.col("source_size") * F.lit(float(most_epochs)))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("all_weight", F.sum("weight").over(every))
        .withColumn("most_before", F.coalesce(F.sum("most").over(by_ratio), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)))
        .withColumn("limited", (F.col("total") - F.col("most_before")) * F.col("weight") > F.col("most") * (F.col("all_weight") - F.col("weight_before")))
    )
    free = limit.withColumn("left", F.col("total") - F.coalesce(F.sum(F.when(F.col("limited"), F.col("most"))).over(every), F.lit(0.0))).withColumn(
        "free_weight", F.sum(F.when(~F.col("limited"), F.col("weight"))).over(every)
    )
    return free.select("source_key", "source_size", F.when(F.col("limited"), F.col("most")).otherwise(F.col("left") * F.col("weight") / F.col("free_weight")).alias("target"))


def mix_key(id_col: str, text_col: str, seed: int) -> Column:
    """A document's place in the random order of its source."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    return F.md5(F.concat(F.lit(f"{seed}:"), name, F.lit(":"), F.md5(text_or_empty(text_col).cast("binary"))).cast("binary"))


def source_key(source_col: str) -> Column:
    """Never null, in code point order with the null source last: "=name" < "~"."""
    return F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("~"))


def _groups(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[int], most_epochs: int, seed: int) -> DataFrame:
    """A row for each source and key: rows (how many have it), more (how many of them the last epoch takes), epochs, ..."""
    sized = materialize(
        docs.select(F.col(id_col).alias("doc_id"), source_key(source_col).alias("source_key"), words(text_col).alias("size"), mix_key(id_col, text_col, seed).alias("mix_key"))
        .groupBy("source_key", "mix_key", "doc_id", "size").agg(F.count(F.lit(1)).alias("rows")),
        "sizes",
    )
    sized = sized.withColumn("range", F.substring("mix_key", 1, RANGE_DIGITS)).withColumn("words", F.col("size") * F.col("rows"))
    # A row for each source and key range: no window below ever holds a whole source.
    ranges = sized.groupBy("source_key", "range").agg(F.sum("words").alias("range_size"))
    ranges = ranges.withColumn("range_before", F.sum("range_size").over(Window.partitionBy("source_key").orderBy("range")) - F.col("range_size"))
    targets = source_targets(sized.groupBy("source_key").agg(F.sum("words").alias("source_size")), weights, most_epochs)
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")).withColumn(
        "rest", F.col("target") - F.col("epochs") * F.col("source_size")
    )
    per_range = ranges.join(_small(targets), "source_key")
    upto = Window.partitionBy("source_key", "range").orderBy("mix_key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = sized.withColumn("before", F.sum("words").over(upto) - F.col("words"))
    base = F.col("range_before") + F.col("before")
    # The n-th of equal rows is taken if its middle lies before the cut.
    fits = lambda n: (base + n * F.col("size")) * 2 - F.col("size") <= F.col("rest") * 2
    about = F.floor((F.col("rest") * 2 - base * 2 + F.col("size")) / F.greatest(F.col("size") * 2, F.lit(1))).cast("long")
    near = F.when(F.col("size") == 0, F.when(base <= F.col("rest"), F.col("rows")).otherwise(0)).when(fits(about + 1), about + 1).when(fits(about), about).otherwise(about - 1)
    return running.join(per_range, ["source_key", "range"]).select(
        "source_key", "mix_key", "doc_id", "size", "rows", "source_size", "target", "epochs", F.least(F.greatest(near, F.lit(0)), F.col("rows")).cast("long").alias("more")
    )


def _repeated(df: DataFrame, times: str) -> DataFrame:
    """Each row that many times (0 too). Rows that recur very often are dealt to many tasks."""
    chunks = df.withColumn("_chunk", F.explode(F.when(F.col(times) > 0, F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / F.lit(CHUNK_ROWS)).cast("long")))))
    if not df.filter(F.col(times) > CHUNK_ROWS).isEmpty():
        chunks = chunks.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left = F.least(F.col(times) - F.col("_chunk") * CHUNK_ROWS, F.lit(CHUNK_ROWS).cast("long"))
    return chunks.withColumn("_one", F.explode(F.sequence(F.lit(1).cast("long"), left))).drop("_chunk", "_one")


def mix_plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (1, 2, 3), most_epochs: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: how often the mix takes each document."""
    groups = materialize(_groups(docs, id_col, text_col, source_col, weights, most_epochs, seed), "groups")
    source = F.when(F.col("source_key") != "~", F.substring("source_key", 2, 1 << 30)).alias("source")
    split = F.explode(F.array(F.struct(F.col("more").alias("n"), (F.col("epochs") + 1).alias("copies")), F.struct((F.col("rows") - F.col("more")).alias("n"), F.col("epochs").alias("copies"))))
    each = groups.select("doc_id", source, "size", "source_size", "target", split.alias("part")).select("doc_id", "source", "size", "source_size", "target", "part.copies", F.col("part.n").alias("_n"))
    return _repeated(each, "_n").drop("_n")


def _small(targets: DataFrame) -> DataFrame:
    """Broadcast while the sources are few, else left to a shuffle join."""
    return F.broadcast(targets) if targets.select("source_key").limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else targets


def mix_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (1, 2, 3), most_epochs: int = 3, seed: int = 42) -> DataFrame:
    """The mix itself: the input's rows, each as often as the plan takes it (0 to most_epochs times)."""
    groups = _groups(docs, id_col, text_col, source_col, weights, most_epochs, seed)
    # What the last epoch takes is a prefix in key order, so a row for each source decides,
    # and the texts need no shuffle. Only equal rows between which the cut falls are counted.
    cut = (F.col("more") > 0) & (F.col("more") < F.col("rows"))
    ends = groups.groupBy(F.col("source_key").alias("_mix_source")).agg(
        F.max("epochs").alias("_mix_epochs"),
        F.max(F.when(F.col("more") == F.col("rows"), F.col("mix_key"))).alias("_mix_end"),
        F.max(F.when(cut, F.col("mix_key"))).alias("_mix_cut"),
        F.max(F.when(cut, F.col("more"))).alias("_mix_more"),
    )
    ends = materialize(ends, "ends")
    small = F.broadcast(ends) if ends.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else ends
    joined = docs.join(small, source_key(source_col) == F.col("_mix_source")).withColumn("_mix_key", mix_key(id_col, text_col, seed))
    copies = F.col("_mix_epochs") + F.coalesce((F.col("_mix_key") <= F.col("_mix_end")).cast("long"), F.lit(0))
    whole = joined.filter(~F.col("_mix_key").eqNullSafe(F.col("_mix_cut"))).withColumn("_mix_copies", copies).filter("_mix_copies > 0")
    taken = whole.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_copies")))).select(docs.columns)
    if ends.filter("_mix_cut is not null").isEmpty():
        return taken
    counted = joined.filter(F.col("_mix_key") == F.col("_mix_cut")).groupBy(*docs.columns, "_mix_source", "_mix_epochs", "_mix_more").agg(F.count(F.lit(1)).alias("_mix_rows"))
    # Equal in id and text, these may differ in other columns: the first in their order are taken once more.
    before = F.coalesce(F.sum("_mix_rows").over(Window.partitionBy("_mix_source").orderBy(*docs.columns).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = F.least(F.greatest(F.col("_mix_more") - before, F.lit(0)), F.col("_mix_rows"))
    total = counted.withColumn("_mix_total", F.col("_mix_epochs") * F.col("_mix_rows") + more)
    return taken.unionByName(_repeated(total, "_mix_total").select(docs.columns))
