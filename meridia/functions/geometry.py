"""Geometries as columns: strict reading from JSON, accessors, conversions, writing.

A geometry of any kind is the sparse struct ``types.GEOM``. Ordinates beyond x and y are
kept as read; the columnar forms (``xy_*``) have x and y only unless asked otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import GEOM, SR
from .checked import as_bool, as_f64, as_i64, as_str, is_absent, let, member

KINDS = ("point", "multipoint", "polygon", "polyline", "envelope")
DIMS = {"XY": 2, "XYZ": 3, "XYM": 3, "XYZM": 4}
#: Source shape -> geometry kind it becomes.
SHAPES = {"POINT": "point", "MULTIPOINT": "multipoint", "LINESTRING": "polyline", "MULTILINESTRING": "polyline", "POLYGON": "polygon", "MULTIPOLYGON": "polygon"}

# Fixed values of the wire format: names written, then other spellings read.
GEOMETRY_TYPES = {"point": "esriGeometryPoint", "multipoint": "esriGeometryMultipoint", "polyline": "esriGeometryPolyline", "polygon": "esriGeometryPolygon"}
_ALIASES = {"esriGeometryMultiPoint": "multipoint", "esriGeometryLineString": "polyline"}

_NUM = "BIGINT|DOUBLE|FLOAT|DECIMAL[(][0-9]+,[0-9]+[)]"


def kind_of_type(geometry_type: str) -> str:
    """The kind a columnar geometry of that wire type has; others raise."""
    for kind, name in GEOMETRY_TYPES.items():
        if name == geometry_type:
            return kind
    if geometry_type in _ALIASES:
        return _ALIASES[geometry_type]
    raise ValueError(f"geometry type {geometry_type!r} has no column form")


# --- reading ---------------------------------------------------------------


def spatial_reference(value: Column) -> Column:
    """A spatial reference object, in either spelling of its keys; null if absent."""

    def read(v: Column) -> Column:
        def number(snake: str, camel: str) -> Column:
            return F.coalesce(as_i64(member(v, snake)), as_i64(member(v, camel)))

        found = F.struct(
            as_i64(member(v, "wkid")).alias("wkid"),
            number("latest_wkid", "latestWkid").alias("latest_wkid"),
            number("vcs_wkid", "vcsWkid").alias("vcs_wkid"),
            number("latest_vcs_wkid", "latestVcsWkid").alias("latest_vcs_wkid"),
            as_str(member(v, "wkt")).alias("wkt"),
        )
        return F.when(F.schema_of_variant(v).startswith("OBJECT"), found)

    return let(value, read)


def _coordinates(value: Column, depth: int, dim: int) -> Column:
    """Nested arrays of dim numbers each, or null if the value is anything else."""
    inner = f"(VOID|{_NUM})"
    for _ in range(depth):
        inner = f"(VOID|ARRAY<{inner}>)"

    def fits(a: Column, level: int) -> Column:
        if level == 1:
            return a.isNotNull() & (F.size(a) == dim) & F.forall(a, lambda o: o.isNotNull())
        return a.isNotNull() & F.forall(a, lambda x: fits(x, level - 1))

    # Null elements vanish from the type, so they are looked for in the values.
    typed = F.schema_of_variant(value).startswith("ARRAY") & F.schema_of_variant(value).rlike(f"^{inner}$")
    arrays = F.when(typed, F.try_variant_get(value, "$", "array<" * depth + "double" + ">" * depth))
    return let(arrays, lambda a: F.when(fits(a, depth), a))


_ENVELOPE = ("xmin", "ymin", "xmax", "ymax", "zmin", "zmax", "mmin", "mmax")


def geom_from_variant(value: Column, dim: int = 2, mode: str = "failfast") -> Column:
    """JSON object -> GEOM. The first kind that matches wins: point, multipoint, polygon,
    polyline, envelope; unknown members don't count. Absent stays null; anything else
    raises, or is null with mode="permissive"."""
    if dim not in (2, 3, 4):
        raise ValueError("dim is 2, 3 or 4")
    refused = F.lit(None).cast(GEOM) if mode == "permissive" else F.raise_error(F.lit("no geometry of that dimension")).cast(GEOM)
    numbers, flags = ("x", "y", "z", "m", *_ENVELOPE), ("hasZ", "hasM")

    def read(v: Column) -> Column:
        """Each member's value, null if it doesn't fit, and which optional ones are wrong."""
        return F.struct(
            *[as_f64(member(v, n)).alias(n) for n in numbers],
            *[as_bool(member(v, n)).alias(n) for n in flags],
            *[_coordinates(member(v, n), depth, dim).alias(n) for n, depth in (("points", 2), ("rings", 3), ("paths", 3))],
            *[(~is_absent(member(v, n))).alias(f"has_{n}") for n in ("z", "m", "zmin", "zmax", "mmin", "mmax", *flags)],
            spatial_reference(member(v, "spatialReference")).alias("spatialReference"),
        )

    def classify(p: Column) -> Column:
        def optional(*names: str) -> Column:
            good = F.lit(True)
            for n in names:
                good = good & (~p[f"has_{n}"] | p[n].isNotNull())
            return good

        kind = (
            F.when(p["x"].isNotNull() & p["y"].isNotNull() & optional("z", "m"), "point")
            .when(p["points"].isNotNull() & optional(*flags), "multipoint")
            .when(p["rings"].isNotNull() & optional(*flags), "polygon")
            .when(p["paths"].isNotNull() & optional(*flags), "polyline")
            .when(p["xmin"].isNotNull() & p["ymin"].isNotNull() & p["xmax"].isNotNull() & p["ymax"].isNotNull() & optional("zmin", "zmax", "mmin", "mmax"), "envelope")
        )
        return F.struct(kind.alias("kind"), p.alias("p"))

    def shape(c: Column) -> Column:
        p = c["p"]

        def only(names: tuple[str, ...], *kinds: str) -> list[Column]:
            return [F.when(c["kind"].isin(*kinds), p[n]).alias(n) for n in names]

        found = F.struct(
            c["kind"].alias("kind"), *only(("x", "y", "z", "m"), "point"), *only(flags, "multipoint", "polygon", "polyline"), *only(("points",), "multipoint"),
            *only(("rings",), "polygon"), *only(("paths",), "polyline"), *only(_ENVELOPE, "envelope"), p["spatialReference"].alias("spatialReference"),
        ).cast(GEOM)
        return F.when(c["kind"].isNull(), refused).otherwise(found)

    return let(value, lambda v: F.when(is_absent(v), F.lit(None).cast(GEOM)).otherwise(let(let(read(v), classify), shape)))


def geom_from_json(text: Column, dim: int = 2, mode: str = "failfast") -> Column:
    parsed = F.try_parse_json(text) if mode == "permissive" else F.parse_json(text)
    return geom_from_variant(parsed, dim, mode)


# --- accessors -------------------------------------------------------------


def _as(geom: Column, kind: str, *names: str) -> Column:
    return let(geom, lambda g: F.when(g["kind"] == kind, F.struct(*[g[n].alias(n) for n in names])))


def as_point(geom: Column) -> Column:
    return _as(geom, "point", "x", "y", "z", "m", "spatialReference")


def as_multipoint(geom: Column) -> Column:
    return _as(geom, "multipoint", "hasZ", "hasM", "points", "spatialReference")


def as_polyline(geom: Column) -> Column:
    return _as(geom, "polyline", "hasZ", "hasM", "paths", "spatialReference")


def as_polygon(geom: Column) -> Column:
    return _as(geom, "polygon", "hasZ", "hasM", "rings", "spatialReference")


def as_envelope(geom: Column) -> Column:
    return _as(geom, "envelope", "xmin", "ymin", "xmax", "ymax", "zmin", "zmax", "mmin", "mmax", "spatialReference")


def coord_x(coord: Column) -> Column:
    return F.get(coord, F.lit(0))


def coord_y(coord: Column) -> Column:
    return F.get(coord, F.lit(1))


def num_parts(parts: Column) -> Column:
    """Points of a multipoint, coordinates of a path, paths of a polyline; null for null."""
    return F.when(parts.isNotNull(), F.size(parts))


def part(parts: Column, i: int | Column) -> Column:
    """The i-th part (from 0), null beyond the last."""
    return F.get(parts, i if isinstance(i, Column) else F.lit(i))


def explode_parts(parts: Column) -> Column:
    """Iteration: (pos, col) rows."""
    return F.posexplode(parts)


def exterior(rings: Column) -> Column:
    """The first ring; null if there is none."""
    return F.get(rings, F.lit(0))


def num_interiors(rings: Column) -> Column:
    return F.when(rings.isNotNull(), F.greatest(F.size(rings) - 1, F.lit(0)))


def interior(rings: Column, i: int | Column) -> Column:
    at = i if isinstance(i, Column) else F.lit(i)
    return F.when(at >= 0, F.get(rings, at + 1))


def interiors(rings: Column) -> Column:
    return F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0)))


# --- conversions to the columnar forms -------------------------------------


def xy(coord: Column, keep: int = 2) -> Column:
    """A coordinate as struct<x,y>, or with its further ordinates as z and m."""
    names = ("x", "y", "z", "m")[:keep]
    return F.struct(*[F.get(coord, F.lit(i)).alias(n) for i, n in enumerate(names)])


def drop_zm(coord: Column) -> Column:
    return F.slice(coord, 1, 2)


def xy_point(point: Column, keep_zm: bool = False) -> Column:
    names = ("x", "y", "z", "m") if keep_zm else ("x", "y")
    return let(point, lambda p: F.when(p.isNotNull(), F.struct(*[p[n].alias(n) for n in names])))


def xy_points(points: Column, keep: int = 2) -> Column:
    return F.transform(points, lambda c: xy(c, keep))


def xy_paths(paths: Column, keep: int = 2) -> Column:
    return F.transform(paths, lambda p: F.transform(p, lambda c: xy(c, keep)))


def close_ring(ring: Column) -> Column:
    """Repeats the first coordinate at the end of an open ring."""
    return let(ring, lambda r: F.when((F.size(r) > 0) & (F.get(r, F.lit(0)) != F.element_at(r, -1)), F.concat(r, F.slice(r, 1, 1))).otherwise(r))


def xy_polygon(rings: Column, keep: int = 2, closed: bool = True) -> Column:
    """Rings as x and y, closed; a polygon without rings raises."""
    kind = "array<array<struct<" + ",".join(f"{n}:double" for n in ("x", "y", "z", "m")[:keep]) + ">>>"

    def shape(rs: Column) -> Column:
        shaped = F.transform(rs, lambda r: F.transform(close_ring(r) if closed else r, lambda c: xy(c, keep)))
        return F.when(F.size(rs) == 0, F.raise_error(F.lit("polygon without rings")).cast(kind)).otherwise(shaped)

    return let(rings, shape)


def geometry_column(geom: Column, geometry_type: str, keep_zm: bool = False, dim: int = 2) -> Column:
    """The typed column of a set's geometries; geometries of another kind become null."""
    kind, keep = kind_of_type(geometry_type), dim if keep_zm else 2
    if kind == "point":
        return xy_point(as_point(geom), keep_zm)
    if kind == "multipoint":
        return let(geom, lambda g: F.when(g["kind"] == kind, xy_points(g["points"], keep)))
    name = "paths" if kind == "polyline" else "rings"
    return let(geom, lambda g: F.when(g["kind"] == kind, xy_paths(g[name], keep)))


# --- construction and writing ----------------------------------------------


def matrix_to_coords(flat: Column, nrow: int | Column, dim: int) -> Column:
    """A column-major matrix of nrow rows as a list of coordinates."""
    n = nrow if isinstance(nrow, Column) else F.lit(nrow)
    rows = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(rows, lambda i: F.array(*[F.get(flat, i + n * k) for k in range(dim)]))


def coords_to_matrix(coords: Column, dim: int) -> Column:
    """The inverse: coordinates as a column-major list."""

    def column(k: int) -> Column:
        return F.transform(coords, lambda c: F.get(c, F.lit(k)))

    return F.flatten(F.array(*[column(k) for k in range(dim)]))


def sr_literal(sr: dict | Column | None) -> Column:
    if isinstance(sr, Column):
        return sr
    if sr is None:
        return F.lit(None).cast(SR)
    known = ("wkid", "latest_wkid", "vcs_wkid", "latest_vcs_wkid")
    wire = {"latestWkid": "latest_wkid", "vcsWkid": "vcs_wkid", "latestVcsWkid": "latest_vcs_wkid"}
    given = {wire.get(k, k): v for k, v in sr.items()}
    if unknown := set(given) - {*known, "wkt"}:
        raise ValueError(f"unknown members of a spatial reference: {sorted(unknown)}")
    return F.struct(*[F.lit(given.get(k)).cast("bigint").alias(k) for k in known], F.lit(given.get("wkt")).cast("string").alias("wkt")).cast(SR)


def _finite(o: Column) -> Column:
    """NaN is written as null."""
    return F.nanvl(o.cast("double"), F.lit(None).cast("double"))


def _coord(c: Column, dim: int) -> Column:
    return F.array(*[_finite(F.get(c, F.lit(i))) for i in range(dim)])


def to_wire(column: Column, shape: str, layout: str = "XY", sr: dict | Column | None = None) -> Column:
    """Nested arrays of coordinates as the wire's geometry struct.

    POINT: one coordinate; MULTIPOINT and LINESTRING: coordinates; MULTILINESTRING and
    POLYGON: lists of them; MULTIPOLYGON: lists of those, whose rings become one list.
    Empty lists stay empty and keep flags and reference; an empty point is null.
    """
    if shape not in SHAPES or layout not in DIMS:
        raise ValueError(f"unknown shape {shape!r} or layout {layout!r}")
    dim, has_z, has_m, ref = DIMS[layout], "Z" in layout, "M" in layout, sr_literal(sr)
    coords = lambda a: F.transform(a, lambda c: _coord(c, dim))

    def point(c: Column) -> Column:
        members = [_finite(F.get(c, F.lit(i))).alias(n) for i, n in enumerate(layout.lower())]
        return F.when(c.isNotNull() & (F.size(c) > 0), F.struct(*members, ref.alias("spatialReference")))

    def parts(c: Column) -> Column:
        if shape == "MULTIPOINT":
            name, listed = "points", coords(c)
        elif shape == "LINESTRING":
            name, listed = "paths", F.when(F.size(c) > 0, F.array(coords(c))).otherwise(F.array().cast("array<array<array<double>>>"))
        else:
            name = "paths" if shape == "MULTILINESTRING" else "rings"
            listed = F.transform(F.flatten(c) if shape == "MULTIPOLYGON" else c, coords)
        return F.when(c.isNotNull(), F.struct(F.lit(has_z).alias("hasZ"), F.lit(has_m).alias("hasM"), listed.alias(name), ref.alias("spatialReference")))

    return let(column, point if shape == "POINT" else parts)


def geometry_json(column: Column, shape: str, layout: str = "XY", sr: dict | Column | None = None) -> Column:
    return F.to_json(to_wire(column, shape, layout, sr))


def geom_to_json(geom: Column, wire: str = "snake") -> Column:
    """GEOM back to JSON. Absent members are left out, except an envelope's, written as null."""

    def write(g: Column) -> Column:
        ref = g["spatialReference"]
        if wire == "camel":
            ref = F.when(ref.isNotNull(), F.struct(ref["wkid"].alias("wkid"), ref["latest_wkid"].alias("latestWkid"), ref["vcs_wkid"].alias("vcsWkid"), ref["latest_vcs_wkid"].alias("latestVcsWkid"), ref["wkt"].alias("wkt")))

        def of(*names: str) -> Column:
            return F.struct(*[g[n].alias(n) for n in names], ref.alias("spatialReference"))

        return (
            F.when(g["kind"] == "point", F.to_json(of("x", "y", "z", "m")))
            .when(g["kind"] == "multipoint", F.to_json(of("hasZ", "hasM", "points")))
            .when(g["kind"] == "polyline", F.to_json(of("hasZ", "hasM", "paths")))
            .when(g["kind"] == "polygon", F.to_json(of("hasZ", "hasM", "rings")))
            .when(g["kind"] == "envelope", F.to_json(of(*_ENVELOPE), {"ignoreNullFields": "false"}))
        )

    return let(geom, write)


def to_shape(geom: Column, shape: str) -> Column:
    """GEOM back to nested coordinate arrays (the inverse of to_wire where it has one)."""
    kind = SHAPES[shape]
    name = {"multipoint": "points", "polyline": "paths", "polygon": "rings", "point": "x"}[kind]

    def read(g: Column) -> Column:
        if shape == "POINT":
            parts = F.filter(F.array(g["x"], g["y"], g["z"], g["m"]), lambda o: o.isNotNull())
        elif shape == "LINESTRING":
            parts = F.get(g[name], F.lit(0))
        else:
            parts = F.array(g[name]) if shape == "MULTIPOLYGON" else g[name]
        return F.when(g["kind"] == kind, parts)

    return let(geom, read)
