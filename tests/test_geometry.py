import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from meridia.functions import checked
from meridia.functions import geometry as G


#: Errors inside values come wrapped or bare, as the plan is folded or run.
REFUSED = (PySparkException, Py4JJavaError)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def read(spark, text, dim=2, mode="failfast"):
    return one(spark, G.geom_from_json(F.lit(text), dim, mode))


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ('{"x":1,"y":2}', "point"), ('{"x":1,"y":2,"rings":[]}', "point"), ('{"points":[[1,2],[3,4]]}', "multipoint"), ('{"rings":[]}', "polygon"), ('{"paths":[[[1,2],[3,4]]]}', "polyline"),
        ('{"xmin":0,"ymin":0,"xmax":1,"ymax":1}', "envelope"), ("null", None),
    ],
)
def test_kinds(spark, text, kind):
    found = read(spark, text)
    assert (found and found.kind) == kind


@pytest.mark.parametrize("text", ['{"points":[[1,2,3]]}', '{"points":[[1,"NaN"]]}', '{"points":[[1,null]]}', '{"x":null,"y":2}', "{}", '{"x":"1","y":2}', '{"points":[null]}', "5", '{"x":1,"y":2,"z":"a"}', '{"points":[[1,2]],"hasZ":3}'])
def test_refused(spark, text):
    with pytest.raises(REFUSED):
        read(spark, text)
    assert read(spark, text, mode="permissive") is None


def test_not_json(spark):
    with pytest.raises(REFUSED):
        read(spark, "{")
    assert read(spark, "{", mode="permissive") is None
    with pytest.raises(ValueError):
        G.geom_from_json(F.lit("{}"), dim=5)


@pytest.mark.parametrize("text", ['{"x":1,"y":2,"spatialReference":{"wkid":102100,"latestWkid":3857}}', '{"x":1,"y":2,"spatialReference":{"wkid":102100,"latest_wkid":3857}}'])
def test_reference_in_either_spelling(spark, text):
    ref = read(spark, text).spatialReference
    assert (ref.wkid, ref.latest_wkid, ref.wkt) == (102100, 3857, None)
    for wire, key in (("snake", "latest_wkid"), ("camel", "latestWkid")):
        again = json.loads(one(spark, G.geom_to_json(G.geom_from_json(F.lit(text)), wire)))
        assert again["spatialReference"] == {"wkid": 102100, key: 3857}


SQUARE = [[0.0, 0.0], [0.0, 1.0], [1.0, 1.0], [1.0, 0.0], [0.0, 0.0]]


def lit(value):
    if isinstance(value, list):
        return F.array(*map(lit, value)) if value else F.array()
    return F.lit(value)


@pytest.mark.parametrize(
    ("value", "shape", "layout", "expected"),
    [
        ([1.0, 2.0], "POINT", "XY", '{"x":1.0,"y":2.0}'), ([1.0, 2.0, 3.0], "POINT", "XYZ", '{"x":1.0,"y":2.0,"z":3.0}'), ([1.0, 2.0, 3.0], "POINT", "XYM", '{"x":1.0,"y":2.0,"m":3.0}'),
        ([1.0, 2.0, 3.0, 4.0], "POINT", "XYZM", '{"x":1.0,"y":2.0,"z":3.0,"m":4.0}'),
        ([[1.0, 6.0], [2.0, 7.0]], "LINESTRING", "XY", '{"hasZ":false,"hasM":false,"paths":[[[1.0,6.0],[2.0,7.0]]]}'),
        ([[1.0, 5.0, 9.0]], "LINESTRING", "XYM", '{"hasZ":false,"hasM":true,"paths":[[[1.0,5.0,9.0]]]}'),
        ([SQUARE], "POLYGON", "XY", '{"hasZ":false,"hasM":false,"rings":[[[0.0,0.0],[0.0,1.0],[1.0,1.0],[1.0,0.0],[0.0,0.0]]]}'),
        ([[1.0, float("nan")]], "MULTIPOINT", "XY", '{"hasZ":false,"hasM":false,"points":[[1.0,null]]}'),
    ],
)
def test_written(spark, value, shape, layout, expected):
    assert one(spark, G.geometry_json(lit(value), shape, layout)) == expected


def test_empty_and_null_geometries(spark):
    rows = spark.createDataFrame([(None, None, None, None), ([], [], [], [])], "p array<double>, c array<array<double>>, r array<array<array<double>>>, m array<array<array<array<double>>>>")
    null, empty = rows.select(
        G.geometry_json(F.col("p"), "POINT"), G.geometry_json(F.col("c"), "MULTIPOINT"), G.geometry_json(F.col("c"), "LINESTRING", "XYZ", {"wkid": 1}), G.geometry_json(F.col("r"), "POLYGON"), G.geometry_json(F.col("m"), "MULTIPOLYGON")
    ).collect()
    assert tuple(null) == (None,) * 5
    flags = '{"hasZ":false,"hasM":false,'
    assert tuple(empty) == (None, flags + '"points":[]}', '{"hasZ":true,"hasM":false,"paths":[],"spatialReference":{"wkid":1}}', flags + '"rings":[]}', flags + '"rings":[]}')


def test_polygon_without_rings(spark):
    p = G.geom_from_json(F.lit('{"rings":[]}'))
    assert one(spark, G.exterior(p["rings"])) is None and one(spark, G.num_interiors(p["rings"])) == 0 and one(spark, G.interiors(p["rings"])) == []
    with pytest.raises(REFUSED):
        one(spark, G.xy_polygon(p["rings"]))


def test_out_of_range_parts(spark):
    p = G.geom_from_json(F.lit('{"points":[[1,2]]}'))["points"]
    assert one(spark, G.part(p, 0)) == [1.0, 2.0] and one(spark, G.part(p, 1)) is None and one(spark, G.part(p, -1)) is None
    rings = G.geom_from_json(F.lit('{"rings":[[[1,2]],[[3,4]]]}'))["rings"]
    assert one(spark, G.interior(rings, 0)) == [[3.0, 4.0]] and one(spark, G.interior(rings, -1)) is None


def test_unknown_names():
    for call in (lambda: G.to_wire(F.lit(None), "CIRCLE"), lambda: G.to_wire(F.lit(None), "POINT", "XYY"), lambda: G.kind_of_type("esriGeometryEnvelope"), lambda: G.sr_literal({"epsg": 1})):
        with pytest.raises(ValueError, match="."):
            call()
    assert G.kind_of_type("esriGeometryLineString") == "polyline"


number = st.floats(-1e6, 1e6, allow_nan=False).map(lambda v: round(v, 3) + 0.0)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.data())
def test_write_read_round_trip(spark, data):
    layout = data.draw(st.sampled_from(list(G.DIMS)))
    coord = st.lists(number, min_size=G.DIMS[layout], max_size=G.DIMS[layout])
    line = st.lists(coord, max_size=4)
    shapes = {"POINT": coord, "MULTIPOINT": line, "LINESTRING": st.lists(coord, min_size=1, max_size=4), "MULTILINESTRING": st.lists(line, max_size=3), "POLYGON": st.lists(line, max_size=3)}
    values = {s: data.draw(strategy) for s, strategy in shapes.items()}
    types = {"POINT": "array<double>", "MULTIPOINT": "array<array<double>>", "LINESTRING": "array<array<double>>", "MULTILINESTRING": "array<array<array<double>>>", "POLYGON": "array<array<array<double>>>"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{s} {t}" for s, t in types.items()))
    back = df.select(*[G.to_shape(G.geom_from_json(G.geometry_json(F.col(s), s, layout), G.DIMS[layout]), s).alias(s) for s in values]).first()
    assert back.asDict() == values


@pytest.mark.parametrize(
    ("type_name", "expected"),
    [
        ("SmallInteger", [5, None, None, 4464, None, None]), ("Integer", [5, None, None, 70000, None, None]), ("OID", [5, None, None, 70000, None, None]), ("Single", [5.0, 5.0, None, 70000.0, None, None]),
        ("Double", [5.0, 5.0, None, 70000.0, None, None]), ("String", [None, None, "5", None, None, None]), ("GUID", [None, None, "5", None, None, None]), ("GlobalID", [None, None, "5", None, None, None]), ("XML", [None, None, "5", None, None, None]),
    ],
)
def test_attribute_values(spark, type_name, expected):
    values = F.array(*[checked.attribute(F.parse_json(F.lit(t)), f"esriFieldType{type_name}") for t in ("5", "5.0", '"5"', "70000", "true", "null")])
    assert one(spark, values) == expected


def test_attribute_dates_blobs_and_refused_types(spark):
    date = lambda t: F.unix_millis(checked.attribute(F.parse_json(F.lit(t)), "esriFieldTypeDate"))
    assert one(spark, date("70000")) == 70000 and one(spark, date("5.0")) is None
    blob = lambda t, p=False: checked.attribute(F.parse_json(F.lit(t)), "esriFieldTypeBlob", p)
    assert one(spark, blob("null")) is None and one(spark, blob("5", True)) is None
    with pytest.raises(REFUSED):
        one(spark, blob("5"))
    for name in ("esriFieldTypeGeometry", "esriFieldTypeRaster", "esriFieldTypeNew", "esrifieldtypestring"):
        with pytest.raises(ValueError, match="field type"):
            checked.attribute(F.lit(None), name)
    assert one(spark, checked.attribute(F.parse_json(F.lit('"a"')), "esriFieldTypeNew", True)) == "a"
    assert one(spark, checked.wrap_int(F.lit(9223372036854775807), 32)) == -1
    assert one(spark, checked.as_str(checked.member(F.parse_json(F.lit('{"a b.\\"c":"x"}')), 'a b."c'))) == "x"
