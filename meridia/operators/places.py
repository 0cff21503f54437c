"""Places search over a DataFrame of places, as distributed filters.

Choices where the service's meaning is not published: distances are haversine on a sphere
of 6371008.8 m, bounds are inclusive, an extent with xmin > xmax wraps the antimeridian,
text matches case-insensitively as a substring of the name or a category label, and
results are ordered by distance, then by id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EARTH_M = 6371008.8
DEFAULT_RADIUS_M = 1000.0
MOST_CATEGORIES = 10
MOST_TEXT = 255
LEAST_FILTER = 3


def distance_m(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Great-circle metres between two points in degrees."""
    a = F.pow(F.sin(F.radians(y2 - y1) / 2), 2) + F.cos(F.radians(y1)) * F.cos(F.radians(y2)) * F.pow(F.sin(F.radians(x2 - x1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def in_extent(x: Column, y: Column, xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    across = (x >= xmin) & (x <= xmax) if xmin <= xmax else (x >= xmin) | (x <= xmax)
    return across & (y >= ymin) & (y <= ymax)


def _near_box(x: Column, y: Column, x0: float, y0: float, radius: float) -> Column:
    """Cheap bounds that contain the circle; plain comparisons, so files can be skipped."""
    import math

    dy = math.degrees(radius / EARTH_M) * 1.0000001
    rows = (y >= y0 - dy) & (y <= y0 + dy)
    if abs(y0) + dy >= 90:
        return rows
    dx = math.degrees(math.asin(min(1.0, math.sin(math.radians(dy)) / math.cos(math.radians(y0))))) * 1.0000001
    if dx >= 180:
        return rows
    low, high = x0 - dx, x0 + dx
    if low < -180:
        return rows & ((x >= low + 360) | (x <= high))
    if high > 180:
        return rows & ((x >= low) | (x <= high - 360))
    return rows & (x >= low) & (x <= high)


def has_category(categories: Column, ids: Sequence[str] | None) -> Column:
    """Any of the ids; no ids, no filter."""
    if not ids:
        return F.lit(True)
    if len(ids) > MOST_CATEGORIES:
        raise ValueError(f"at most {MOST_CATEGORIES} categories")
    return F.exists(categories, lambda c: c["categoryId"].isin(*ids))


def matches_text(name: Column, categories: Column, text: str | None) -> Column:
    if text is None:
        return F.lit(True)
    if len(text) > MOST_TEXT:
        raise ValueError(f"at most {MOST_TEXT} characters")
    low = F.lower(F.lit(text))
    return F.coalesce(F.contains(F.lower(name), low), F.lit(False)) | F.coalesce(F.exists(categories, lambda c: F.contains(F.lower(c["label"]), low)), F.lit(False))


def within_extent(places: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float, category_ids: Sequence[str] | None = None, search_text: str | None = None) -> DataFrame:
    loc = F.col("location")
    return places.filter(in_extent(loc["x"], loc["y"], xmin, ymin, xmax, ymax)).filter(has_category(F.col("categories"), category_ids)).filter(matches_text(F.col("name"), F.col("categories"), search_text))


def near_point(places: DataFrame, x: float, y: float, radius: float | None = None, category_ids: Sequence[str] | None = None, search_text: str | None = None) -> DataFrame:
    """Places within the radius, with their distance (replacing a column of that name)."""
    radius = DEFAULT_RADIUS_M if radius is None else radius
    loc = F.col("location")
    near = places.filter(_near_box(loc["x"], loc["y"], x, y, radius)).withColumn("distance", distance_m(F.lit(float(x)), F.lit(float(y)), loc["x"], loc["y"]))
    return near.filter(F.col("distance") <= radius).filter(has_category(F.col("categories"), category_ids)).filter(matches_text(F.col("name"), F.col("categories"), search_text))


def filter_categories(categories: DataFrame, text: str | None = None) -> DataFrame:
    """Categories with the text in a part of their label."""
    if text is None:
        return categories
    if len(text) < LEAST_FILTER:
        raise ValueError(f"at least {LEAST_FILTER} characters")
    low = F.lower(F.lit(text))
    return categories.filter(F.exists("fullLabel", lambda label: F.contains(F.lower(label), low)))


def category_details(categories: DataFrame, category_id: str) -> DataFrame:
    return categories.filter(F.col("categoryId") == category_id)


def child_categories(categories: DataFrame, category_id: str) -> DataFrame:
    return categories.filter(F.array_contains("parents", category_id))


def in_language(labels: Column, language: str, default: str = "en") -> Column:
    """A map from language to label -> the label, falling back from fr-CA to fr to the default."""
    parts = language.split("-")
    chain = ["-".join(parts[:n]) for n in range(len(parts), 0, -1)]
    return F.coalesce(*[F.try_element_at(labels, F.lit(c)) for c in dict.fromkeys([*chain, default])])


def icon(icons: Column, kind: str) -> Column:
    """A map from svg, cim or png to URL -> icon record."""
    if kind not in ("svg", "cim", "png"):
        raise ValueError(f"unknown icon {kind!r}")
    return F.struct(F.try_element_at(icons, F.lit(kind)).alias("url"))


def place_details(details: DataFrame, place_ids: DataFrame | Sequence[str], requested_fields: Sequence[str] = ("all",)) -> DataFrame:
    """Details of places by id, with the requested fields only.

    "all" is every field, "group" or "group:member" a part; placeId always stays. Members
    of one group come back under the group, so Parquet reads only those columns.
    """
    found = details.join(place_ids.select("placeId").distinct(), "placeId", "left_semi") if isinstance(place_ids, DataFrame) else details.filter(F.col("placeId").isin(*place_ids))
    return project_fields(found, requested_fields)


def project_fields(details: DataFrame, requested_fields: Sequence[str]) -> DataFrame:
    if "all" in requested_fields:
        return details
    wanted: dict[str, list[str] | None] = {}
    for name in requested_fields:
        group, _, member = name.partition(":")
        if group not in details.columns:
            raise ValueError(f"unknown field {name!r}")
        if not member:
            wanted[group] = None
        elif wanted.get(group, []) is not None:
            wanted.setdefault(group, []).append(member)
    wanted.pop("placeId", None)
    columns = [F.col("placeId")]
    for group, members in wanted.items():
        columns.append(F.col(group) if members is None else F.when(F.col(group).isNotNull(), F.struct(*[F.col(f"{group}.{m}").alias(m) for m in dict.fromkeys(members)])).alias(group))
    return details.select(*columns)


def pages(results: DataFrame, page_size: int, order: Sequence[str] = ("distance", "placeId"), by: Sequence[str] = ()) -> DataFrame:
    """Adds page (from 1) and row in page, in the given order.

    Without ``by`` the order is over all results, which one task numbers; pass a key where
    results of many searches are paged at once.
    """
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return results.withColumn("_n", n).withColumn("page", (F.floor(F.col("_n") / page_size) + 1).cast("int")).withColumn("page_row", (F.col("_n") % page_size + 1).cast("int")).drop("_n")


def nearest(results: DataFrame, k: int) -> DataFrame:
    return results.orderBy("distance", "placeId").limit(k)
