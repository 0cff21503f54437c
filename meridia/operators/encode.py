"""Rows to features and feature sets as JSON.

Attributes become variant objects, which keep null members and sort their keys. Arrays of
features are ordered by ``order_by``; without it they are in the order in which rows are
read, which holds over retries only if nothing was shuffled before. An array is one string
made by one task: without ``by`` a whole table is, so write feature lines for large data,
or sets in pages, which no task holds whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..functions.fieldtypes import written_field_type

#: The spatial reference the data frame writers fall back to.
DEFAULT_SR = {"wkid": 3857}
#: Bytes of features at which a page is closed.
PAGE_BYTES = 256 << 10
#: Rows of a group that are ordered together, on average; one order key in so many is broadcast.
RANGE_ROWS = 1024


def check_attributes(schema: T.StructType, names: list[str]) -> None:
    """Raises for columns that cannot be attributes."""
    for name in names:
        written_field_type(schema[name].dataType.simpleString())


def _attribute(schema: T.StructType, name: str) -> Column:
    kind, c = schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        whole = F.isnan(c) | (F.abs(c) == float("inf"))
        return F.when(whole, F.raise_error(F.lit(f"attribute {name} is not finite")).cast(kind)).otherwise(c)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_millis(c.cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_millis(c.cast("timestamp"))
    if isinstance(kind, T.BinaryType):
        return F.base64(c)
    return c


def attributes(df: DataFrame, names: list[str]) -> Column:
    """Columns as one variant object; no columns give the empty object."""
    check_attributes(df.schema, names)
    if not names:
        return F.parse_json(F.lit("{}"))
    return F.to_variant_object(F.struct(*[_attribute(df.schema, n).alias(n) for n in names]))


def _geometry(geometry: str | None, shape: str | None, layout: str, sr: dict | None) -> Column:
    if geometry is None:
        return F.lit(None).cast("struct<x:double>")
    if layout == "XYZM":
        raise ValueError("features have three ordinates at most")
    return G.to_wire(F.col(geometry), shape, layout, sr)


def feature_json(df: DataFrame, names: list[str], geometry: str | None = None, shape: str | None = None, layout: str = "XY", sr: dict | None = None) -> Column:
    """One feature as JSON, for newline-delimited output: no aggregate, no shuffle."""
    return F.to_json(F.struct(_geometry(geometry, shape, layout, sr).alias("geometry"), attributes(df, names).alias("attributes")))


def _collected(df: DataFrame, feature: Column, order_by: str | None, by: list[str]) -> DataFrame:
    order = F.col(order_by) if order_by else F.monotonically_increasing_id()
    rows = df.select(*by, order.alias("_o"), feature.alias("_j"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("_o", "_j"))), lambda e: e["_j"])
    listed = F.concat(F.lit("["), F.concat_ws(",", texts), F.lit("]")).alias("features")
    return rows.groupBy(*by).agg(listed)


def features_json(df: DataFrame, names: list[str], geometry: str | None = None, shape: str | None = None, layout: str = "XY", sr: dict | None = None, default_sr: dict | None = None, order_by: str | None = None, by: list[str] | None = None) -> DataFrame:
    """by..., features: a JSON array for each group; each geometry carries the reference."""
    feature = feature_json(df, names, geometry, shape, layout, sr or default_sr)
    return _collected(df, feature, order_by, by or [])


def feature_set_json(
    df: DataFrame, names: list[str], geometry: str | None = None, shape: str | None = None, layout: str = "XY", sr: dict | None = None, default_sr: dict | None = DEFAULT_SR, order_by: str | None = None, by: list[str] | None = None, with_fields: bool = True, object_id: str | None = None
) -> DataFrame:
    """by..., featureset: one set for each group; the set alone carries the reference."""
    by = by or []
    collected = _collected(df, feature_json(df, names, geometry, shape, layout, None), order_by, by)
    return collected.select(*by, _set_json(df, names, geometry, shape, layout, sr or default_sr, with_fields, object_id).alias("featureset"))


def _set_json(df: DataFrame, names: list[str], geometry: str | None, shape: str | None, layout: str, reference: dict | None, with_fields: bool, object_id: str | None) -> Column:
    """The set around the column ``features``."""
    members = []
    if object_id:
        members.append(F.concat(F.lit('"objectIdFieldName":'), _quoted(object_id)))
    if geometry is not None:
        members.append(F.lit(f'"geometryType":"{G.GEOMETRY_TYPES[G.SHAPES[shape]]}"'))
        members.append(F.lit(f'"hasZ":{str("Z" in layout).lower()},"hasM":{str("M" in layout).lower()}'))
    if reference is not None:
        members.append(F.concat(F.lit('"spatialReference":'), F.to_json(G.sr_literal(reference))))
    if with_fields:
        fields = [F.struct(F.lit(n).alias("name"), F.lit("esriFieldTypeOID" if n == object_id else _field_name(df, n)).alias("type")) for n in names]
        members.append(F.concat(F.lit('"fields":'), F.to_json(F.array(*fields)) if fields else F.lit("[]")))
    members.append(F.concat(F.lit('"features":'), F.col("features")))
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


def _at_most(bounds: Column, key: Column) -> Column:
    """How many of the sorted bounds are at most the key, by bisection; 0 for a null key or no bounds."""

    def halve(at: Column, _: Column) -> Column:
        middle = F.shiftright(at["low"] + at["high"], 1)
        after = F.struct((middle + 1).alias("low"), at["high"].alias("high"))
        before = F.struct(at["low"].alias("low"), middle.alias("high"))
        return F.when(at["low"] >= at["high"], at).when(F.get(bounds, middle) <= key, after).otherwise(before)

    begin = F.struct(F.lit(0).alias("low"), F.size(bounds).alias("high"))
    return F.when(bounds.isNull(), F.lit(0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.length(F.bin(F.size(bounds)))), begin, halve)["low"])


def feature_set_pages(
    df: DataFrame, names: list[str], order_by: str, geometry: str | None = None, shape: str | None = None, layout: str = "XY", sr: dict | None = None, default_sr: dict | None = DEFAULT_SR, by: list[str] | None = None, with_fields: bool = True, object_id: str | None = None
) -> DataFrame:
    """by..., start, featureset: each group's set as sets of consecutive features, from the start-th (from 0) on.

    A page is closed at PAGE_BYTES, so it is larger by one feature at most, and no task holds
    a group: its rows are cut into ranges of the order key. The ranges' bounds are keys chosen
    by their hash, so every reading of the rows finds the same. Rows equal in key stay
    together, in the order of their features' texts; null keys come first. A group without
    rows has no page.
    """
    by = by or []
    rows = df.select(*by, F.col(order_by).alias("_o"), feature_json(df, names, geometry, shape, layout, None).alias("_j"))

    def with_small(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        """right has a row for RANGE_ROWS of left at most, by hash; its keys may be null."""
        renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
        on = F.lit(True)
        for k in keys:
            on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"`_r_{k}`"))
        return left.join(F.broadcast(renamed), on, "left").drop(*[f"_r_{k}" for k in keys])

    chosen = rows.filter(F.pmod(F.xxhash64(*by, "_o"), F.lit(RANGE_ROWS)) == 0)
    bounds = chosen.groupBy(*by).agg(F.array_sort(F.collect_set("_o")).alias("_bounds"))
    ranged = with_small(rows, bounds, by).withColumn("_range", _at_most(F.col("_bounds"), F.col("_o"))).drop("_bounds")
    sizes = ranged.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_size"))
    first = sizes.withColumn("_first", F.sum("_size").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_size")).drop("_size")
    # The first range of a group begins at 0, so groups without bounds need no row here.
    first = first.filter("_range > 0")

    in_order = Window.partitionBy(*by, "_range").orderBy(F.col("_o").asc_nulls_first(), "_j")
    bytes_before = F.sum(F.octet_length("_j").cast("long")).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.octet_length("_j")
    placed = ranged.select(*by, "_range", "_j", F.row_number().over(in_order).alias("_n"), F.floor(bytes_before / F.lit(PAGE_BYTES)).alias("_page"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("_n", "_j"))), lambda e: e["_j"])
    made = placed.groupBy(*by, "_range", "_page").agg((F.min("_n") - 1).cast("long").alias("_start"), F.concat(F.lit("["), F.concat_ws(",", texts), F.lit("]")).alias("features"))
    start = F.col("_start") + F.coalesce(F.col("_first"), F.lit(0).cast("long"))
    return with_small(made, first, [*by, "_range"]).select(*by, start.alias("start"), _set_json(df, names, geometry, shape, layout, sr or default_sr, with_fields, object_id).alias("featureset"))


def _quoted(text: str) -> Column:
    return F.to_json(F.array(F.lit(text))).substr(F.lit(2), F.length(F.to_json(F.array(F.lit(text)))) - 2)


def _field_name(df: DataFrame, name: str) -> str:
    return written_field_type(df.schema[name].dataType.simpleString())


def column_features_json(df: DataFrame, geometry: str, shape: str, layout: str = "XY", sr: dict | None = None, order_by: str | None = None, by: list[str] | None = None) -> DataFrame:
    """A geometry column alone as features with empty attributes; no default reference."""
    return features_json(df, [], geometry, shape, layout, sr, None, order_by, by)


def column_feature_set_json(df: DataFrame, geometry: str, shape: str, layout: str = "XY", sr: dict | None = None, order_by: str | None = None, by: list[str] | None = None) -> DataFrame:
    """A geometry column alone as a set with empty attributes; no default reference."""
    return feature_set_json(df, [], geometry, shape, layout, sr, None, order_by, by, with_fields=False)


def column_feature_set_pages(df: DataFrame, geometry: str, shape: str, order_by: str, layout: str = "XY", sr: dict | None = None, by: list[str] | None = None) -> DataFrame:
    """As column_feature_set_json, in pages."""
    return feature_set_pages(df, [], order_by, geometry, shape, layout, sr, None, by, with_fields=False)
