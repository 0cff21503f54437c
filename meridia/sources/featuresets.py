"""Readers and writers of feature files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import decode, encode


def read_feature_sets(spark: SparkSession, path: str, **options) -> DataFrame:
    """Files that each hold one feature set -> one typed table.

    A set is one record until its features are exploded; repartition afterwards if a few
    files hold most features, or keep features one a line (read_features).
    """
    texts = spark.read.text(path, wholetext=True)
    return decode.feature_set_table(texts, "value", **options)


def read_features(spark: SparkSession, path: str, info: decode.FeatureSetInfo, **options) -> DataFrame:
    """Newline-delimited features; files split, so this is the form for large data."""
    return decode.features_from_lines(spark.read.text(path), info, "value", **options)


def write_features(df: DataFrame, path: str, names: list[str], **geometry) -> None:
    """Newline-delimited features, written in parallel."""
    df.select(encode.feature_json(df, names, **geometry).alias("value")).write.text(path)


def write_feature_sets(df: DataFrame, path: str, names: list[str], **options) -> None:
    """One feature set a line, a line for each group. A group is one string in one task."""
    encode.feature_set_json(df, names, **options).select("featureset").write.text(path)
