"""Feature sets, features and geometries from JSON text to typed tables.

The plan is one scan and projections: parse the text once into a variant, explode the
features, read each declared field by a checked accessor, put the geometry last. The only
driver action is the look at the sets' metadata, which a caller can avoid by passing it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import checked
from ..functions import geometry as G
from ..functions.fieldtypes import spark_type

#: Members of a set besides its features.
_META = ("objectIdFieldName", "globalIdFieldName", "displayFieldName", "geometryType", "spatialReference", "hasZ", "hasM", "fields")


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    alias: str | None = None
    sqlType: str | None = None
    domain: object = None
    defaultValue: object = None

    @staticmethod
    def of(raw: dict) -> Field:
        if "name" not in raw or "type" not in raw:
            raise ValueError(f"a field needs a name and a type: {raw}")
        return Field(raw["name"], raw["type"], raw.get("alias"), raw.get("sqlType"), raw.get("domain"), raw.get("defaultValue"))

    def to_struct_field(self, permissive: bool = False) -> T.StructField:
        """Nullable, with what Spark has no place for as metadata."""
        extra = {k: v for k, v in (("type", self.type), ("alias", self.alias), ("sqlType", self.sqlType), ("domain", json.dumps(self.domain) if self.domain is not None else None), ("defaultValue", json.dumps(self.defaultValue) if self.defaultValue is not None else None)) if v is not None}
        return T.StructField(self.name, T._parse_datatype_string(spark_type(self.type, permissive)), True, extra)


@dataclass(frozen=True)
class FeatureSetInfo:
    """A set without its features."""

    fields: tuple[Field, ...]
    geometry_type: str | None = None
    spatial_reference: dict | None = None
    has_z: bool | None = None
    has_m: bool | None = None
    object_id_field: str | None = None
    global_id_field: str | None = None
    display_field: str | None = None
    raw: dict = field(default_factory=dict, compare=False, hash=False)

    @staticmethod
    def of(raw: dict) -> FeatureSetInfo:
        if raw.get("fields") is None:
            raise ValueError("a feature set needs fields to become a table")
        return FeatureSetInfo(
            tuple(Field.of(f) for f in raw["fields"]), raw.get("geometryType"), raw.get("spatialReference"), raw.get("hasZ"), raw.get("hasM"), raw.get("objectIdFieldName"), raw.get("globalIdFieldName"), raw.get("displayFieldName"), raw
        )

    def schema(self, permissive: bool = False) -> T.StructType:
        """The attribute columns in the declared order."""
        return T.StructType([f.to_struct_field(permissive) for f in self.fields])


def parse(df: DataFrame, json_col: str = "value", mode: str = "failfast") -> DataFrame:
    """Adds the column ``doc``: the text as a variant (permissive: null if it isn't JSON)."""
    return df.withColumn("doc", F.try_parse_json(json_col) if mode == "permissive" else F.parse_json(json_col))


def feature_set_info(df: DataFrame, json_col: str = "value") -> FeatureSetInfo:
    """The metadata all sets of a column share; sets with different fields raise."""
    doc = F.try_parse_json(F.col(json_col))
    meta = F.struct(*[F.to_json(checked.member(doc, m)).alias(m) for m in _META])
    found = df.filter(F.col(json_col).isNotNull()).select(meta.alias("m")).distinct().limit(2).collect()
    if len(found) != 1:
        raise ValueError("no feature set" if not found else "the sets differ in their metadata; read them apart")
    return FeatureSetInfo.of({k: json.loads(v) for k, v in found[0]["m"].asDict().items() if v is not None})


def explode_features(df: DataFrame, json_col: str = "value", mode: str = "failfast", keep: tuple[str, ...] = ()) -> DataFrame:
    """feature_index and feature (variant) for each feature of each set."""
    doc = F.try_parse_json(F.col(json_col)) if mode == "permissive" else F.parse_json(F.col(json_col))
    features = F.try_variant_get(doc, "$.features", "array<variant>")
    if mode != "permissive":
        features = F.when(F.col(json_col).isNotNull() & features.isNull(), F.raise_error(F.lit("a feature set needs features")).cast("array<variant>")).otherwise(features)
    return df.select(*keep, F.posexplode(features).alias("feature_index", "feature"))


def _checked_attributes(feature: Column, info: FeatureSetInfo, mode: str) -> Column:
    """The attributes object, or an error inside the value if it doesn't fit the fields."""
    attributes = checked.member(feature, "attributes")
    if mode == "permissive":
        return attributes
    keys = F.map_keys(F.try_variant_get(attributes, "$", "map<string,variant>"))
    extra = F.array_except(keys, F.array(*[F.lit(f.name) for f in info.fields]).cast("array<string>"))
    return (
        F.when(~F.coalesce(F.schema_of_variant(attributes).startswith("OBJECT"), F.lit(False)), F.raise_error(F.lit("a feature without attributes")).cast("variant"))
        .when(F.size(extra) > 0, F.raise_error(F.concat(F.lit("undeclared attribute "), F.get(extra, F.lit(0)))).cast("variant"))
        .otherwise(attributes)
    )


def feature_table(features: DataFrame, info: FeatureSetInfo, feature_col: str = "feature", dim: int = 2, mode: str = "failfast", keep_zm: bool = False, geometry_name: str = "geometry", keep: tuple[str, ...] = ()) -> DataFrame:
    """Features (variants) -> declared columns in order, then the geometry if the set has a type."""
    # Null elements of the feature array aren't features in either mode.
    checked_rows = features.withColumn("_attributes", _checked_attributes(F.col(feature_col), info, mode))
    columns = []
    for f in info.fields:
        value = checked.attribute(checked.member(F.col("_attributes"), f.name), f.type, mode == "permissive")
        columns.append(value.alias(f.name, metadata=f.to_struct_field(mode == "permissive").metadata))
    if info.geometry_type is not None:
        geom = G.geom_from_variant(checked.member(F.col(feature_col), "geometry"), dim, mode)
        meta = {"geometryType": G.GEOMETRY_TYPES[G.kind_of_type(info.geometry_type)], "column": geometry_name, "index": len(columns)}
        if info.spatial_reference:
            meta["spatialReference"] = json.dumps(info.spatial_reference)
        columns.append(G.geometry_column(geom, info.geometry_type, keep_zm, dim).alias(geometry_name, metadata=meta))
    return checked_rows.select(*keep, *columns)


def feature_set_table(df: DataFrame, json_col: str = "value", info: FeatureSetInfo | None = None, dim: int = 2, mode: str = "failfast", keep_zm: bool = False, geometry_name: str = "geometry", keep: tuple[str, ...] = ()) -> DataFrame:
    """A column of feature sets -> one typed table. Pass info to plan without an action."""
    info = info or feature_set_info(df, json_col)
    return feature_table(explode_features(df, json_col, mode, keep), info, "feature", dim, mode, keep_zm, geometry_name, keep)


def features_from_lines(df: DataFrame, info: FeatureSetInfo, json_col: str = "value", **options) -> DataFrame:
    """One feature a row (newline-delimited JSON): the form that splits and scales."""
    mode = options.get("mode", "failfast")
    return feature_table(parse(df, json_col, mode).withColumnRenamed("doc", "feature"), info, **options)


def generic_features(features: DataFrame, feature_col: str = "feature", dim: int = 2, mode: str = "failfast") -> DataFrame:
    """geometry (GEOM) and attributes (map of variants): features without a schema."""
    f = F.col(feature_col)
    return features.withColumn("geometry", G.geom_from_variant(checked.member(f, "geometry"), dim, mode)).withColumn("attributes", F.try_variant_get(checked.member(f, "attributes"), "$", "map<string,variant>"))


def validate(df: DataFrame) -> int:
    """Materialises every value, so that errors inside values surface; returns the rows."""
    hashed = df.select(F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).alias("h"))
    # The checksum needs the values; a count alone would let the optimizer drop them.
    return hashed.agg(F.count(F.lit(1)), F.bit_xor("h")).first()[0]
