"""Feature decoding on streams.

Decoding is row by row and keeps no state, so it runs unchanged on a stream once the
fields are given; only the look at metadata, a driver action, is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decode


def stream_features(spark: SparkSession, path: str, info: decode.FeatureSetInfo, **options) -> DataFrame:
    """New files of newline-delimited features as a typed stream."""
    return decode.features_from_lines(spark.readStream.text(path), info, "value", **options)


def stream_feature_sets(spark: SparkSession, path: str, info: decode.FeatureSetInfo, **options) -> DataFrame:
    """New files of one feature set each as a typed stream."""
    texts = spark.readStream.option("wholetext", True).text(path)
    return decode.feature_set_table(texts, "value", info=info, **options)


def count_in_cells(stream: DataFrame, time_col: str, geometry_col: str = "geometry", cell_deg: float = 1.0, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Points in each grid cell and event-time window; later rows than the watermark are dropped."""
    cell = lambda c: F.floor(F.col(f"{geometry_col}.{c}") / cell_deg).cast("int")
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, window).alias("window"), cell("x").alias("cell_x"), cell("y").alias("cell_y")).agg(F.count(F.lit(1)).alias("n"))
