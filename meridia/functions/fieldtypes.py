"""Field types and SQL types of the wire format, their codes, names and Spark types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FieldType:
    code: int
    name: str
    spark: str | None  # None: no column can have it


# Fixed values of the wire format, by code.
FIELD_TYPES = (
    FieldType(0, "esriFieldTypeSmallInteger", "smallint"),
    FieldType(1, "esriFieldTypeInteger", "int"),
    FieldType(2, "esriFieldTypeSingle", "float"),
    FieldType(3, "esriFieldTypeDouble", "double"),
    FieldType(4, "esriFieldTypeString", "string"),
    FieldType(5, "esriFieldTypeDate", "timestamp"),
    FieldType(6, "esriFieldTypeOID", "bigint"),
    FieldType(7, "esriFieldTypeGeometry", None),
    FieldType(8, "esriFieldTypeBlob", "binary"),
    FieldType(9, "esriFieldTypeRaster", None),
    FieldType(10, "esriFieldTypeGUID", "string"),
    FieldType(11, "esriFieldTypeGlobalID", "string"),
    FieldType(12, "esriFieldTypeXML", "string"),
)
DEFAULT_FIELD_TYPE = "esriFieldTypeString"

# Fixed values of the wire format, by code, with the Spark type each maps to here.
SQL_TYPES = (
    ("sqlTypeBigInt", "bigint"),
    ("sqlTypeBinary", "binary"),
    ("sqlTypeBit", "boolean"),
    ("sqlTypeChar", "string"),
    ("sqlTypeDate", "date"),
    ("sqlTypeDecimal", "decimal(38,18)"),
    ("sqlTypeDouble", "double"),
    ("sqlTypeFloat", "double"),
    ("sqlTypeGeometry", "geometry"),
    ("sqlTypeGUID", "string"),
    ("sqlTypeInteger", "int"),
    ("sqlTypeLongNVarchar", "string"),
    ("sqlTypeLongVarbinary", "binary"),
    ("sqlTypeLongVarchar", "string"),
    ("sqlTypeNChar", "string"),
    ("sqlTypeNVarchar", "string"),
    ("sqlTypeOther", "string"),
    ("sqlTypeReal", "float"),
    ("sqlTypeSmallInt", "smallint"),
    ("sqlTypeSqlXml", "string"),
    ("sqlTypeTime", "string"),
    ("sqlTypeTimestamp", "timestamp"),
    ("sqlTypeTimestamp2", "timestamp"),
    ("sqlTypeTinyInt", "tinyint"),
    ("sqlTypeVarbinary", "binary"),
    ("sqlTypeVarchar", "string"),
)

_BY_NAME = {t.name: t for t in FIELD_TYPES}


def field_type(name: str, permissive: bool = False) -> FieldType:
    """Case-sensitive; unknown names raise, or are strings if permissive."""
    if name not in _BY_NAME and not permissive:
        raise ValueError(f"unknown field type {name!r}")
    return _BY_NAME.get(name, _BY_NAME[DEFAULT_FIELD_TYPE])


def spark_type(name: str, permissive: bool = False) -> str:
    found = field_type(name, permissive)
    if found.spark is None:
        raise ValueError(f"no column can have the field type {name}")
    return found.spark


#: Spark type -> field type, for writing.
_WRITTEN = {"tinyint": 0, "smallint": 0, "int": 1, "float": 2, "double": 3, "string": 4, "timestamp": 5, "timestamp_ntz": 5, "date": 5, "bigint": 1, "boolean": 4, "binary": 8}


def written_field_type(spark: str) -> str:
    kind = "double" if spark.startswith("decimal") else spark
    if kind not in _WRITTEN:
        raise ValueError(f"columns of type {spark} cannot be attributes")
    return FIELD_TYPES[_WRITTEN[kind]].name


def field_type_code(name: Column) -> Column:
    """Name -> code as a column; null for unknown names."""
    return F.get(F.create_map(*[x for t in FIELD_TYPES for x in (F.lit(t.name), F.array(F.lit(t.code)))])[name], F.lit(0))


def field_type_name(code: Column) -> Column:
    return F.get(F.array(*[F.lit(t.name) for t in FIELD_TYPES]), code)
