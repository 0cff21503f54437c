"""Strict reads of variant values: no coercion, so "7" is not a number and 5.0 no integer.

Casts of variants coerce, so each accessor tests the value's type first and gives null
where it does not fit. Integers narrow by wrapping, as two's complement does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fieldtypes import spark_type

_NUMBER = "^(BIGINT|DOUBLE|FLOAT|DECIMAL[(].*[)])$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it.

    Without this, accessors of accessors would double an expression at every level.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def member(value: Column, name: str) -> Column:
    """An object's member as a variant; null if there is none or the value is no object."""
    for quote in "\"'":
        if quote not in name:
            return F.try_variant_get(value, f"$[{quote}{name}{quote}]", "variant")
    # Paths have no escapes: a name with both quotes is looked up in a map.
    return F.try_element_at(F.try_variant_get(value, "$", "map<string,variant>"), F.lit(name))


def as_i64(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "BIGINT", F.try_variant_get(value, "$", "bigint"))


def as_f64(value: Column) -> Column:
    return F.when(F.schema_of_variant(value).rlike(_NUMBER), F.try_variant_get(value, "$", "double"))


def as_str(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def as_bool(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))


def is_absent(value: Column) -> Column:
    """Missing, or JSON null."""
    return value.isNull() | (F.schema_of_variant(value) == "VOID")


def wrap_int(value: Column, bits: int) -> Column:
    """The low bits as a signed integer; never overflows."""
    low = value.cast("bigint").bitwiseAND(F.lit((1 << bits) - 1))
    signed = F.when(low >= F.lit(1 << (bits - 1)), low - F.lit(1 << bits)).otherwise(low)
    return signed.cast({8: "tinyint", 16: "smallint", 32: "int"}[bits])


def attribute(value: Column, type_name: str, permissive: bool = False) -> Column:
    """A variant as the column value of a field type; a value of another type gives null."""
    spark = spark_type(type_name, permissive)
    if type_name == "esriFieldTypeDate":
        return F.timestamp_millis(as_i64(value))
    if spark == "smallint":
        return wrap_int(as_i64(value), 16)
    if spark == "int":
        return wrap_int(as_i64(value), 32)
    if spark == "bigint":
        return as_i64(value)
    if spark in ("float", "double"):
        return as_f64(value).cast(spark)
    if spark == "binary":
        refuse = F.raise_error(F.lit("blob attributes cannot be read from JSON")).cast("binary")
        return F.when(is_absent(value), F.lit(None).cast("binary")).otherwise(F.lit(None).cast("binary") if permissive else refuse)
    return as_str(value)
