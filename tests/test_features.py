import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from meridia.operators import decode, encode
from meridia.sources import featuresets
from meridia.streaming import decode as streaming

#: Errors inside values come wrapped or bare, as the plan is folded or run.
REFUSED = (PySparkException, Py4JJavaError)

FIELDS = [{"name": "id", "type": "esriFieldTypeOID", "alias": "Id"}, {"name": "the name", "type": "esriFieldTypeString", "domain": {"a": 1}}]


def feature_set(features, **more):
    return json.dumps({"geometryType": "esriGeometryPoint", "fields": FIELDS, "spatialReference": {"wkid": 4326}, "features": features, **more})


GOOD = [{"geometry": {"x": 1, "y": 2}, "attributes": {"id": 1, "the name": "a"}}, {"attributes": {"id": 2}}, {"geometry": {"points": []}, "attributes": {"id": 3, "the name": 4}}]


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_table(spark):
    table = decode.feature_set_table(texts(spark, feature_set(GOOD)))
    assert [tuple(r) for r in table.collect()] == [(1, "a", (1.0, 2.0)), (2, None, None), (3, None, None)]
    assert table.columns == ["id", "the name", "geometry"]
    assert table.schema["the name"].metadata["domain"] == '{"a": 1}' and table.schema["id"].metadata["alias"] == "Id"
    assert table.schema["geometry"].metadata["index"] == 2
    assert decode.validate(table) == 3


def test_other_geometry_types(spark):
    line = {"geometry": {"paths": [[[1, 2, 3], [4, 5, 6]]], "hasZ": True}, "attributes": {"id": 1}}
    df = texts(spark, feature_set([line], geometryType="esriGeometryPolyline"))
    assert decode.feature_set_table(df, dim=3).first().geometry == [[(1.0, 2.0), (4.0, 5.0)]]
    assert decode.feature_set_table(df, dim=3, keep_zm=True).first().geometry[0][1] == (4.0, 5.0, 6.0)
    no_type = json.loads(feature_set([line]))
    del no_type["geometryType"]
    assert decode.feature_set_table(texts(spark, json.dumps(no_type))).columns == ["id", "the name"]


@pytest.mark.parametrize("bad", [{"attributes": {"id": 1, "new": 2}}, {"geometry": {"x": 1, "y": 2}}, {"attributes": {"id": 1}, "geometry": {"x": 1}}, {"attributes": None}])
def test_bad_features(spark, bad):
    df = texts(spark, feature_set([bad]))
    with pytest.raises(REFUSED):
        decode.validate(decode.feature_set_table(df))
    assert decode.validate(decode.feature_set_table(df, mode="permissive")) == 1


def test_bad_sets(spark):
    for text in ('{"features":[]}', feature_set([], fields=[{"name": "x", "type": "nope"}]), feature_set([], fields=[{"name": "x"}]), feature_set([], geometryType="esriGeometryEnvelope")):
        with pytest.raises(ValueError, match="."):
            decode.feature_set_table(texts(spark, text))
    with pytest.raises(ValueError, match="differ"):
        decode.feature_set_info(texts(spark, feature_set([]), feature_set([], fields=FIELDS[:1])))
    with pytest.raises(ValueError, match="no feature set"):
        decode.feature_set_info(texts(spark))
    info = decode.feature_set_info(texts(spark, feature_set([])))
    with pytest.raises(REFUSED):
        decode.feature_set_table(texts(spark, '{"fields":[]}'), info=info).collect()
    assert decode.feature_set_table(texts(spark, "{", None, feature_set(GOOD)), info=info, mode="permissive").count() == 3
    permissive = decode.feature_set_table(texts(spark, feature_set([{"attributes": {"x": "t"}}], fields=[{"name": "x", "type": "nope"}])), mode="permissive")
    assert permissive.first().x == "t"


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(2, "b", 2.5, True, [3.0, 4.0, 5.0]), (1, None, None, None, None)], "id long, name string, v double, flag boolean, pt array<double>")
    return df.withColumn("when", F.timestamp_millis(F.lit(1500))).withColumn("day", F.to_date(F.lit("1970-01-02")))


def test_feature_set_members(rows):
    names = ["id", "name", "v", "flag", "when", "day"]
    made = json.loads(encode.feature_set_json(rows, names, "pt", "POINT", "XYZ", order_by="id", object_id="id").first().featureset)
    assert made["features"] == [
        {"attributes": {"day": 86400000, "flag": None, "id": 1, "name": None, "v": None, "when": 1500}},
        {"geometry": {"x": 3.0, "y": 4.0, "z": 5.0}, "attributes": {"day": 86400000, "flag": True, "id": 2, "name": "b", "v": 2.5, "when": 1500}},
    ]
    assert list(made["features"][1]["attributes"]) == sorted(names)
    assert (made["geometryType"], made["hasZ"], made["hasM"], made["spatialReference"], made["objectIdFieldName"]) == ("esriGeometryPoint", True, False, {"wkid": 3857}, "id")
    assert made["fields"][0] == {"name": "id", "type": "esriFieldTypeOID"}


def test_reference_places(rows):
    array = json.loads(encode.features_json(rows, ["id"], "pt", "POINT", "XYM", sr={"wkid": 1}, order_by="id").first().features)
    assert array[1]["geometry"]["spatialReference"] == {"wkid": 1} and array[1]["geometry"]["m"] == 5.0
    alone = json.loads(encode.column_features_json(rows, "pt", "POINT", "XYZ", order_by="id").first().features)
    assert alone == [{"attributes": {}}, {"geometry": {"x": 3.0, "y": 4.0, "z": 5.0}, "attributes": {}}]
    assert "spatialReference" not in json.loads(encode.column_feature_set_json(rows, "pt", "POINT").first().featureset)


def test_refused_attributes(spark, rows):
    with pytest.raises(ValueError, match="ordinates"):
        encode.features_json(rows, ["id"], "pt", "POINT", "XYZM")
    with pytest.raises(ValueError, match="attributes"):
        encode.features_json(rows, ["pt"])
    bad = spark.createDataFrame([(float("nan"),)], "v double")
    with pytest.raises(REFUSED):
        encode.features_json(bad, ["v"]).collect()


def test_files_and_streams(spark, rows, tmp_path):
    info = decode.FeatureSetInfo((decode.Field("id", "esriFieldTypeOID"), decode.Field("name", "esriFieldTypeString")), "esriGeometryPoint")
    lines, sets = str(tmp_path / "lines"), str(tmp_path / "sets")
    featuresets.write_features(rows, lines, ["id", "name"], geometry="pt", shape="POINT", layout="XYZ")
    featuresets.write_feature_sets(rows, sets, ["id", "name"], geometry="pt", shape="POINT", order_by="id", object_id="id")
    expected = [(1, None, None), (2, "b", (3.0, 4.0))]
    assert sorted(tuple(r) for r in featuresets.read_features(spark, lines, info).collect()) == expected
    assert sorted(tuple(r) for r in featuresets.read_feature_sets(spark, sets + "/part-*").collect()) == expected
    for name, stream in (("f", streaming.stream_features(spark, lines, info)), ("s", streaming.stream_feature_sets(spark, sets, info))):
        query = stream.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert sorted(tuple(r) for r in spark.table(name).collect()) == expected


def test_stream_of_cells(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1.5, 2.5), (60, 1.6, 2.6), (4000, 9.0, 9.0)], "s long, x double, y double")
    rows.select(F.timestamp_seconds("s").alias("t"), F.struct("x", "y").alias("geometry")).write.parquet(str(tmp_path / "p"))
    source = spark.readStream.schema("t timestamp, geometry struct<x:double,y:double>").parquet(str(tmp_path / "p"))
    query = streaming.count_in_cells(source, "t").writeStream.outputMode("complete").format("memory").queryName("cells").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.cell_x, r.cell_y, r.n) for r in spark.table("cells").collect()) == [(1, 2, 2), (9, 9, 1)]
