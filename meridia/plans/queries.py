"""Registered queries over the synthetic tables, each with the SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checked
from ..functions import geometry as G
from ..functions.fieldtypes import FIELD_TYPES, SQL_TYPES, field_type_code, field_type_name
from ..operators import decode, encode
from ..operators import places as P

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# The tables hold no geometry; these rules give every customer a place on the globe.


def lon(key: str) -> Column:
    return ((F.col(key) * 37 % 360) - 180).cast("double")


def lat(key: str) -> Column:
    return ((F.col(key) * 53 % 180) - 90).cast("double")


_LON, _LAT = "CAST((c_custkey * 37 % 360) - 180 AS DOUBLE)", "CAST((c_custkey * 53 % 180) - 90 AS DOUBLE)"


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").withColumn("pt", F.array(lon("c_custkey"), lat("c_custkey")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as one feature set a nation, read back into a typed table, searched by extent."""
    sets = encode.feature_set_json(customers(spark, sf_dir).withColumnRenamed("c_nationkey", "nation"), ["c_custkey", "c_name", "c_acctbal"], geometry="pt", shape="POINT", order_by="c_custkey", by=["nation"], object_id="c_custkey")
    rows = decode.feature_set_table(sets, "featureset", info=customer_info(), keep=("nation",))
    inside = rows.filter(P.in_extent(F.col("geometry.x"), F.col("geometry.y"), -90.0, -45.0, 90.0, 45.0))
    return inside.groupBy("nation").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean_balance"))


def customer_info() -> decode.FeatureSetInfo:
    fields = (("c_custkey", "esriFieldTypeOID"), ("c_name", "esriFieldTypeString"), ("c_acctbal", "esriFieldTypeDouble"))
    return decode.FeatureSetInfo(tuple(decode.Field(n, t) for n, t in fields), "esriGeometryPoint", {"wkid": 3857})


query(f"""SELECT c_nationkey AS nation, count(*) AS n, round(avg(c_acctbal), 4) AS mean_balance FROM customer
WHERE {_LON} BETWEEN -90 AND 90 AND {_LAT} BETWEEN -45 AND 45 GROUP BY c_nationkey""")(flagship)


# --- types and attributes ----------------------------------------------------


@query("SELECT * FROM (VALUES " + ", ".join(f"({t.code}, '{t.name}', {repr(t.spark) if t.spark else 'NULL'}, {t.code}, '{t.name}')" for t in FIELD_TYPES) + ") AS v(code, name, spark_type, code_back, name_back)")
def field_type_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(t.code, t.name, t.spark) for t in FIELD_TYPES], "code int, name string, spark_type string")
    return rows.select("code", "name", "spark_type", field_type_code(F.col("name")).alias("code_back"), field_type_name(F.col("code")).alias("name_back"))


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', '{s}')" for i, (n, s) in enumerate(SQL_TYPES)) + ") AS v(code, name, spark_type)")
def sql_type_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(SQL_TYPES)], "code int, name string, spark_type string")


@query("""SELECT event_id, CAST(k AS SMALLINT) AS as_small, CAST(k AS INTEGER) AS as_int, CAST(k AS FLOAT) AS as_single, CAST(k AS DOUBLE) AS as_double,
 CAST(NULL AS VARCHAR) AS as_string, k AS as_oid, k AS as_date_ms FROM (SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events)""")
def attr_decode_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", checked.member(F.parse_json("props"), "k").alias("k"))
    read = {"as_small": "SmallInteger", "as_int": "Integer", "as_single": "Single", "as_double": "Double", "as_string": "String", "as_oid": "OID"}
    columns = [checked.attribute(F.col("k"), f"esriFieldType{t}").alias(n) for n, t in read.items()]
    return rows.select("event_id", *columns, F.unix_millis(checked.attribute(F.col("k"), "esriFieldTypeDate")).alias("as_date_ms"))


@query("""SELECT l_orderkey, l_linenumber, CAST(CASE WHEN (v & 65535) >= 32768 THEN (v & 65535) - 65536 ELSE v & 65535 END AS SMALLINT) AS w16,
 CAST(CASE WHEN (v & 4294967295) >= 2147483648 THEN (v & 4294967295) - 4294967296 ELSE v & 4294967295 END AS INTEGER) AS w32
FROM (SELECT l_orderkey, l_linenumber, (l_orderkey - 3000) * 1000003 AS v FROM lineitem)""")
def attr_int_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = (F.col("l_orderkey") - 3000) * 1000003
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", checked.wrap_int(v, 16).alias("w16"), checked.wrap_int(v, 32).alias("w32"))


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms, make_timestamp(epoch_us(ts) // 1000 * 1000) AS ts_ms FROM events")
def attr_date_millis(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    value = F.parse_json(ms.cast("string"))
    return table(spark, sf_dir, "events").select("event_id", ms.alias("ms"), checked.attribute(value, "esriFieldTypeDate").cast("timestamp_ntz").alias("ts_ms"))


@query("""SELECT event_id % 8 AS form, CASE event_id % 8 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE count(*) END AS n_int, CASE event_id % 8 WHEN 2 THEN count(*) END AS n_string,
 CASE event_id % 8 WHEN 0 THEN count(*) WHEN 1 THEN count(*) WHEN 5 THEN count(*) WHEN 6 THEN count(*) WHEN 7 THEN count(*) END AS n_number FROM events GROUP BY 1""".replace("CASE event_id % 8 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE count(*) END", "CASE event_id % 8 WHEN 0 THEN count(*) WHEN 5 THEN count(*) END"))
def attr_strictness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers, fractions, text, booleans, null, negatives, exponents and huge numbers: what counts as what."""
    forms = F.array(*[F.lit(x) for x in ("5", "5.0", '"5"', "true", "null", "-7", "5e0", "9223372036854775808")])
    value = F.parse_json(F.get(forms, (F.col("event_id") % 8).cast("int")))
    rows = table(spark, sf_dir, "events").select((F.col("event_id") % 8).alias("form"), checked.as_i64(value).alias("i"), checked.as_str(value).alias("s"), checked.as_f64(value).alias("d"))
    some = lambda c: F.nullif(F.count(c), F.lit(0))
    return rows.groupBy("form").agg(some("i").alias("n_int"), some("s").alias("n_string"), some("d").alias("n_number"))


# --- geometry reading and writing ----------------------------------------------

_FORMS = [
    ("point", '{"x":1,"y":2}'), ("point", '{"x":1.5,"y":2,"z":null,"rings":[]}'), ("multipoint", '{"points":[[1,2],[3,4]]}'), ("polygon", '{"rings":[]}'),
    ("polyline", '{"paths":[[[1,2],[3,4]]],"hasZ":false}'), ("envelope", '{"xmin":0,"ymin":0,"xmax":1,"ymax":1e0}'), (None, '{"points":[[1,2,3]]}'), (None, '{"points":[[1,null]]}'),
    (None, '{"points":[[1,"NaN"]]}'), (None, '{"x":null,"y":2}'), (None, "{}"), ("multipoint", '{"points":[]}'), (None, '{"rings":[[[1]]]}'), ("polygon", '{"rings":[[]]}'), (None, '{"paths":[null]}'),
]


@query(f"SELECT event_id, CASE event_id % {len(_FORMS)} " + " ".join(f"WHEN {i} THEN {repr(k) if k else 'NULL'}" for i, (k, _) in enumerate(_FORMS)) + " END AS kind FROM events")
def geom_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.get(F.array(*[F.lit(t) for _, t in _FORMS]), (F.col("event_id") % len(_FORMS)).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", G.geom_from_json(text, 2, "permissive")["kind"].alias("kind"))


@query(f"SELECT c_custkey, to_json({{'x': {_LON}, 'y': {_LAT}}}) AS xy, to_json({{'x': {_LON}, 'y': {_LAT}, 'm': CAST(c_nationkey AS DOUBLE), 'spatialReference': {{'wkid': 4326}}}}) AS xym FROM customer")
def geom_point_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_m = F.concat("pt", F.array(F.col("c_nationkey").cast("double")))
    return customers(spark, sf_dir).select("c_custkey", G.geometry_json(F.col("pt"), "POINT").alias("xy"), G.geometry_json(with_m, "POINT", "XYM", {"wkid": 4326}).alias("xym"))


def _by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, coords: [value, event_id] in order of time."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("e"))
    return rows.select("user_id", F.transform("e", lambda e: F.array(e["value"], e["event_id"].cast("double"))).alias("coords"))


@query("""SELECT user_id, CAST(i - 1 AS INTEGER) AS pos, c[1] AS x, c[2] AS y, CAST(n AS INTEGER) AS n FROM (
 SELECT user_id, len(l) AS n, unnest(l) AS c, generate_subscripts(l, 1) AS i FROM (SELECT user_id, list([value, CAST(event_id AS DOUBLE)] ORDER BY ts, event_id) AS l FROM events GROUP BY user_id))""")
def multipoint_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = G.geometry_json(F.col("coords"), "MULTIPOINT")
    points = G.as_multipoint(G.geom_from_json(text))["points"]
    rows = _by_user(spark, sf_dir).select("user_id", points.alias("points"))
    rows = rows.select("user_id", G.num_parts(F.col("points")).alias("n"), G.explode_parts(F.col("points")).alias("pos", "c"))
    return rows.select("user_id", "pos", G.coord_x(F.col("c")).alias("x"), G.coord_y(F.col("c")).alias("y"), "n")


@query("""SELECT user_id, 2 AS n_paths, CAST(len(l) AS INTEGER) AS n_coords, l[1][1] AS first_x, l[len(l)][2] AS last_y, CAST(NULL AS DOUBLE) AS beyond FROM (
 SELECT user_id, list([value, CAST(event_id AS DOUBLE)] ORDER BY ts, event_id) AS l FROM events GROUP BY user_id)""")
def polyline_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = G.geometry_json(F.array("coords", "coords"), "MULTILINESTRING", sr={"wkid": 3857})
    rows = _by_user(spark, sf_dir).select("user_id", G.as_polyline(G.geom_from_json(text))["paths"].alias("paths"))
    path = G.part(F.col("paths"), 0)
    return rows.select(
        "user_id", G.num_parts(F.col("paths")).alias("n_paths"), G.num_parts(path).alias("n_coords"), G.coord_x(G.part(path, 0)).alias("first_x"),
        G.coord_y(F.element_at(G.part(F.col("paths"), 1), -1)).alias("last_y"), G.coord_x(G.part(G.part(F.col("paths"), 2), 0)).alias("beyond"),
    )


@query("""SELECT user_id, 1 AS n_paths, CAST(len(l) AS INTEGER) AS n_coords, round(list_sum(list_transform(l, lambda c: c[1])), 4) AS sum_x FROM (
 SELECT user_id, list([value, CAST(event_id AS DOUBLE)] ORDER BY ts, event_id) AS l FROM events GROUP BY user_id)""")
def linestring_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = G.as_polyline(G.geom_from_json(G.geometry_json(F.col("coords"), "LINESTRING")))["paths"]
    rows = _by_user(spark, sf_dir).select("user_id", paths.alias("paths"))
    xs = F.transform(G.part(F.col("paths"), 0), G.coord_x)
    return rows.select("user_id", G.num_parts(F.col("paths")).alias("n_paths"), F.size(xs).alias("n_coords"), F.round(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x), 4).alias("sum_x"))


def _matrix(dim: int, nrow: int) -> Column:
    """An embedding, read row by row, as nrow coordinates of dim ordinates."""
    return F.transform(F.sequence(F.lit(0), F.lit(nrow - 1)), lambda i: F.array(*[F.get("embedding", i * dim + k).cast("double") for k in range(dim)]))


def _rings(coords: Column, size: int, count: int) -> Column:
    return F.array(*[F.slice(coords, 1 + size * i, size) for i in range(count)])


@query("""SELECT vec_id, 8 AS exterior_size, 3 AS n_interiors, CAST(embedding[17] AS DOUBLE) AS interior_x, CAST(NULL AS INTEGER) AS beyond, 3 AS all_interiors FROM embeddings""")
def polygon_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rings = G.as_polygon(G.geom_from_json(G.geometry_json(_rings(_matrix(2, 32), 8, 4), "POLYGON")))["rings"]
    rows = table(spark, sf_dir, "embeddings").select("vec_id", rings.alias("r"))
    r = F.col("r")
    return rows.select(
        "vec_id", G.num_parts(G.exterior(r)).alias("exterior_size"), G.num_interiors(r).alias("n_interiors"), G.coord_x(G.part(G.interior(r, 0), 0)).alias("interior_x"),
        G.num_parts(G.interior(r, 3)).alias("beyond"), F.size(G.interiors(r)).alias("all_interiors"),
    )


@query("SELECT vec_id, 4 AS n_rings, CAST(embedding[33] AS DOUBLE) AS third_x FROM embeddings")
def multipolygon_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rings = _rings(_matrix(2, 32), 8, 4)
    polygons = F.array(F.slice(rings, 1, 2), F.slice(rings, 3, 2))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", G.as_polygon(G.geom_from_json(G.geometry_json(polygons, "MULTIPOLYGON")))["rings"].alias("r"))
    return rows.select("vec_id", G.num_parts(F.col("r")).alias("n_rings"), G.coord_x(G.part(G.part(F.col("r"), 2), 0)).alias("third_x"))


@query("""SELECT vec_id, CAST(i AS INTEGER) AS pos, CAST(embedding[4 * i + 1] AS DOUBLE) AS x, CAST(embedding[4 * i + 2] AS DOUBLE) AS y, 2 AS ordinates, CAST(embedding[4 * i + 4] AS DOUBLE) AS kept_m
FROM (SELECT vec_id, embedding, unnest(range(16)) AS i FROM embeddings)""")
def drop_zm(spark: SparkSession, sf_dir: str) -> DataFrame:
    geom = G.geom_from_json(G.geometry_json(_matrix(4, 16), "MULTIPOINT", "XYZM"), dim=4)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", geom["points"].alias("p"))
    rows = rows.select("vec_id", F.posexplode(F.arrays_zip(G.xy_points(F.col("p")).alias("a"), G.xy_points(F.col("p"), 4).alias("b"), F.transform("p", G.drop_zm).alias("c"))).alias("pos", "z"))
    return rows.select("vec_id", "pos", "z.a.x", "z.a.y", F.size("z.c").alias("ordinates"), F.col("z.b.m").alias("kept_m"))


@query("""SELECT vec_id, 33 AS n_closed, CAST(embedding[1] AS DOUBLE) AS last_x, 33 AS n_again, 0 AS n_empty FROM embeddings""")
def ring_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", G.close_ring(_matrix(2, 32)).alias("r"))
    polygon = G.xy_polygon(F.array("r"))
    return rows.select("vec_id", F.size("r").alias("n_closed"), F.element_at("r", -1)[0].alias("last_x"), F.size(polygon[0]).alias("n_again"), F.size(G.close_ring(F.slice("r", 1, 0))).alias("n_empty"))


@query("SELECT vec_id, CAST(embedding[2 + 32] AS DOUBLE) AS y_of_second, true AS back FROM embeddings")
def matrix_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = F.transform("embedding", lambda v: v.cast("double"))
    coords = G.matrix_to_coords(flat, 32, 2)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", flat.alias("flat"), coords.alias("c"))
    return rows.select("vec_id", G.coord_y(G.part(F.col("c"), 1)).alias("y_of_second"), (G.coords_to_matrix(F.col("c"), 2) == F.col("flat")).alias("back"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value END AS x, CASE WHEN event_id % 3 = 1 THEN 2 END AS n_points, CASE WHEN event_id % 3 = 2 THEN 1 END AS n_paths FROM events""")
def geo_column_kind_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.array("value", F.col("event_id").cast("double"))
    text = F.when(F.col("event_id") % 3 == 0, G.geometry_json(c, "POINT")).when(F.col("event_id") % 3 == 1, G.geometry_json(F.array(c, c), "MULTIPOINT")).otherwise(G.geometry_json(F.array(c, c), "LINESTRING"))
    rows = table(spark, sf_dir, "events").select("event_id", G.geom_from_json(text).alias("g"))
    column = lambda t: G.geometry_column(F.col("g"), t)
    size = lambda t: G.num_parts(column(t))
    return rows.select("event_id", column("esriGeometryPoint")["x"].alias("x"), size("esriGeometryMultiPoint").alias("n_points"), size("esriGeometryPolyline").alias("n_paths"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey WHEN c_custkey % 3 = 1 THEN 3857 END AS latest, CASE WHEN c_custkey % 3 < 2 THEN 102100 END AS wkid,
 CAST(CASE WHEN c_custkey % 3 = 2 THEN 3857 ELSE 102100 END AS BIGINT) AS with_default FROM customer""")
def sr_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References in either spelling of their keys; the data frame writers' default where none is."""
    key = F.col("c_custkey")
    text = F.when(key % 3 == 0, F.concat(F.lit('{"wkid":102100,"latest_wkid":'), key, F.lit("}"))).when(key % 3 == 1, F.lit('{"wkid":102100,"latestWkid":3857}')).otherwise(F.lit("null"))
    ref = G.spatial_reference(F.parse_json(text))
    return table(spark, sf_dir, "customer").select("c_custkey", ref["latest_wkid"].alias("latest"), ref["wkid"].alias("wkid"), F.coalesce(ref["wkid"], F.lit(encode.DEFAULT_SR["wkid"]).cast("long")).alias("with_default"))


@query(f"SELECT c_custkey, to_json({{'xmin': {_LON}, 'ymin': {_LAT}, 'xmax': {_LON} + 1, 'ymax': {_LAT} + 1, 'zmin': NULL, 'zmax': NULL, 'mmin': NULL, 'mmax': NULL, 'spatialReference': NULL}}) AS again FROM customer")
def envelope_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("pt")[0], F.col("pt")[1]
    text = F.to_json(F.struct(x.alias("xmin"), y.alias("ymin"), (x + 1).alias("xmax"), (y + 1).alias("ymax")))
    return customers(spark, sf_dir).select("c_custkey", G.geom_to_json(G.geom_from_json(text)).alias("again"))


# --- features and feature sets -----------------------------------------------


@query(f"SELECT c_custkey, c_name, c_acctbal, {_LON} AS x, {_LAT} AS y FROM customer")
def featureset_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = encode.feature_set_json(customers(spark, sf_dir), ["c_custkey", "c_name", "c_acctbal"], geometry="pt", shape="POINT", order_by="c_custkey", by=["c_nationkey"], object_id="c_custkey")
    info = decode.feature_set_info(sets, "featureset")
    return decode.feature_set_table(sets, "featureset", info=info).select("c_custkey", "c_name", "c_acctbal", "geometry.x", "geometry.y")


@query(f"SELECT c_custkey, c_name, c_acctbal, {_LON} AS x, {_LAT} AS y FROM customer")
def feature_lines_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customers(spark, sf_dir)
    lines = rows.select(encode.feature_json(rows, ["c_custkey", "c_name", "c_acctbal"], "pt", "POINT").alias("value"))
    return decode.features_from_lines(lines, customer_info()).select("c_custkey", "c_name", "c_acctbal", "geometry.x", "geometry.y")


@query("SELECT c_nationkey, CAST(i - 1 AS INTEGER) AS pos, k AS c_custkey, 4326 AS wkid FROM (SELECT c_nationkey, unnest(l) AS k, generate_subscripts(l, 1) AS i FROM (SELECT c_nationkey, list(c_custkey ORDER BY c_custkey) AS l FROM customer GROUP BY c_nationkey))")
def features_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of features in order, each geometry with its reference."""
    made = encode.features_json(customers(spark, sf_dir), ["c_custkey"], "pt", "POINT", sr={"wkid": 4326}, order_by="c_custkey", by=["c_nationkey"])
    rows = made.select("c_nationkey", F.posexplode(F.try_variant_get(F.parse_json("features"), "$", "array<variant>")).alias("pos", "feature"))
    rows = decode.generic_features(rows)
    return rows.select("c_nationkey", "pos", checked.as_i64(F.col("attributes")["c_custkey"]).alias("c_custkey"), F.col("geometry.spatialReference.wkid").cast("int").alias("wkid"))


@query("SELECT user_id, CAST(count(*) AS INTEGER) AS n, 0 AS n_attributes, CAST(NULL AS BIGINT) AS geometry_wkid, 'esriGeometryMultipoint' AS geometry_type, false AS has_z, 3857 AS wkid FROM events GROUP BY user_id")
def geometry_column_featureset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A geometry column alone: empty attributes, the reference on the set only."""
    rows = _by_user(spark, sf_dir)
    sets = encode.column_feature_set_json(rows, "coords", "MULTIPOINT", sr={"wkid": 3857}, by=["user_id"])
    doc = F.parse_json("featureset")
    features = decode.explode_features(sets, "featureset", keep=("user_id", "featureset"))
    features = decode.generic_features(features)
    return features.select(
        "user_id", F.size("geometry.points").alias("n"), F.size("attributes").alias("n_attributes"), F.col("geometry.spatialReference.wkid").alias("geometry_wkid"),
        checked.as_str(checked.member(doc, "geometryType")).alias("geometry_type"), checked.as_bool(checked.member(doc, "hasZ")).alias("has_z"),
        G.spatial_reference(checked.member(doc, "spatialReference"))["wkid"].cast("int").alias("wkid"),
    )


@query("""SELECT o_orderkey, to_json({'o_orderdate': epoch_ms(o_orderdate), 'o_orderkey': o_orderkey, 'o_orderstatus': CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END, 'small': o_orderkey % 7}) AS attributes FROM orders""")
def attribute_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers stay integers, nulls keep their keys, keys are sorted, dates are milliseconds."""
    rows = table(spark, sf_dir, "orders").withColumn("small", F.col("o_orderkey") % 7).withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")))
    return rows.select("o_orderkey", F.to_json(encode.attributes(rows, ["small", "o_orderstatus", "o_orderkey", "o_orderdate"])).alias("attributes"))


_SHAPES = {"POINT": "esriGeometryPoint", "MULTIPOINT": "esriGeometryMultipoint", "LINESTRING": "esriGeometryPolyline", "MULTILINESTRING": "esriGeometryPolyline", "POLYGON": "esriGeometryPolygon", "MULTIPOLYGON": "esriGeometryPolygon"}


def _shaped(spark: SparkSession, sf_dir: str, shape: str, layout: str) -> DataFrame:
    """Embeddings as coordinates of that layout in that shape; shapes of several parts get a second one of five coordinates."""
    dim = len(layout)
    coords = _matrix(dim, 64 // dim)
    few = F.slice(coords, 1, 5)
    made = {"POINT": F.get(coords, F.lit(0)), "MULTIPOINT": coords, "LINESTRING": coords, "MULTILINESTRING": F.array(coords, few), "POLYGON": F.array(coords, few), "MULTIPOLYGON": F.array(F.array(coords), F.array(few))}[shape]
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", made.alias("shape"))


def _layout_query(shape: str):
    many = shape not in ("POINT", "LINESTRING", "MULTIPOINT")
    per = lambda layout: f"SELECT vec_id, '{layout}' AS layout, {2 if many else 1} AS n_parts, {64 // len(layout) + (5 if many else 0)} AS n_coords, {'Z' in layout} AS has_z, {'M' in layout} AS has_m, CAST(embedding[{64 // len(layout) * len(layout)}] AS DOUBLE) AS last, true AS back FROM embeddings"

    def layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = []
        for layout in ("XY", "XYZ", "XYM", "XYZM"):
            rows = _shaped(spark, sf_dir, shape, layout)
            rows = rows.withColumn("g", G.geom_from_json(G.geometry_json(F.col("shape"), shape, layout), dim=len(layout)))
            name = {"polyline": "paths", "polygon": "rings", "multipoint": "points"}[G.SHAPES[shape]]
            parts = F.array(F.col("g")[name]) if shape == "MULTIPOINT" else F.col("g")[name]
            # A multipolygon's rings are one list on the wire, so that is what comes back.
            same = F.flatten(F.col("shape")) if shape == "MULTIPOLYGON" else F.col("shape")
            again = F.flatten(G.to_shape(F.col("g"), shape)) if shape == "MULTIPOLYGON" else G.to_shape(F.col("g"), shape)
            out.append(rows.select("vec_id", F.lit(layout).alias("layout"), F.size(parts).alias("n_parts"), F.size(F.flatten(parts)).alias("n_coords"), F.col("g.hasZ").alias("has_z"), F.col("g.hasM").alias("has_m"), F.element_at(F.element_at(parts[0], -1), -1).alias("last"), (again == same).alias("back")))
        return reduce(DataFrame.unionByName, out)

    layouts.__name__ = f"layouts_{shape.lower()}"
    return query(" UNION ALL ".join(per(x) for x in ("XY", "XYZ", "XYM", "XYZM")))(layouts)


def _column_set_query(shape: str, layout: str):
    many = shape not in ("POINT", "LINESTRING", "MULTIPOINT")
    n = 1 if shape == "POINT" else 64 // len(layout) + (5 if many else 0)

    sql = f"SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS pos, {n} AS n_coords, '{_SHAPES[shape]}' AS geometry_type, {'Z' in layout} AS has_z, {'M' in layout} AS has_m, 4326 AS wkid, CAST(NULL AS BIGINT) AS geometry_wkid, 0 AS n_attributes FROM embeddings"
    def column_set(spark: SparkSession, sf_dir: str) -> DataFrame:
        """A geometry column alone as a set of each label, written and read in pages."""
        pages = encode.column_feature_set_pages(_shaped(spark, sf_dir, shape, layout), "shape", shape, "vec_id", layout, sr={"wkid": 4326}, by=["label"])
        doc = F.col("doc")
        # A set's own members are read once a page: the features go on without its text.
        own = {"geometry_type": checked.as_str(checked.member(doc, "geometryType")), "has_z": checked.as_bool(checked.member(doc, "hasZ")), "has_m": checked.as_bool(checked.member(doc, "hasM")), "wkid": G.spatial_reference(checked.member(doc, "spatialReference"))["wkid"].cast("int")}
        rows = decode.generic_features(decode.explode_features(decode.parse(pages, "featureset").withColumns(own), "featureset", keep=("label", "start", *own)), dim=len(layout))
        g = F.col("geometry")
        n_coords = {"point": F.when(g["x"].isNotNull() & g["y"].isNotNull(), 1), "multipoint": F.size(g["points"]), "polyline": F.size(F.flatten(g["paths"])), "polygon": F.size(F.flatten(g["rings"]))}[G.SHAPES[shape]]
        return rows.select("label", (F.col("start") + F.col("feature_index")).cast("int").alias("pos"), n_coords.alias("n_coords"), *own, g["spatialReference"]["wkid"].alias("geometry_wkid"), F.size("attributes").alias("n_attributes"))

    column_set.__name__ = f"column_set_{shape.lower()}"
    return query(sql)(column_set)


for _shape in ("MULTIPOINT", "LINESTRING", "MULTILINESTRING", "POLYGON", "MULTIPOLYGON"):
    _layout_query(_shape)
for _shape, _layout in (("POINT", "XYZ"), ("LINESTRING", "XYM"), ("MULTILINESTRING", "XYZ"), ("POLYGON", "XY"), ("MULTIPOLYGON", "XYZ")):
    _column_set_query(_shape, _layout)


@query("SELECT vec_id, CAST(label AS INTEGER) AS label, 21 AS n_coords, CAST(embedding[63] AS DOUBLE) AS last_z, true AS has_z FROM embeddings")
def featureset_with_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of lines in three dimensions, written and read with their third ordinate."""
    rows = _shaped(spark, sf_dir, "LINESTRING", "XYZ")
    sets = encode.feature_set_json(rows, ["vec_id", "label"], geometry="shape", shape="LINESTRING", layout="XYZ", order_by="vec_id", by=["label"], object_id="vec_id").withColumnRenamed("label", "of")
    info = decode.FeatureSetInfo((decode.Field("vec_id", "esriFieldTypeOID"), decode.Field("label", "esriFieldTypeInteger")), "esriGeometryPolyline", {"wkid": 3857})
    has_z = checked.as_bool(checked.member(F.parse_json("featureset"), "hasZ"))
    got = decode.feature_set_table(sets.withColumn("has_z", has_z), "featureset", info=info, dim=3, keep_zm=True, keep=("has_z",))
    path = F.col("geometry")[0]
    return got.select("vec_id", "label", F.size(path).alias("n_coords"), F.element_at(path, -1)["z"].alias("last_z"), "has_z")


@query("SELECT * FROM (VALUES (0, 'c_custkey', 'esriFieldTypeOID', NULL, NULL), (1, 'c_name', 'esriFieldTypeString', NULL, NULL), (2, 'c_acctbal', 'esriFieldTypeDouble', NULL, NULL), (3, 'where', NULL, 3, 'esriGeometryPoint')) AS v(position, name, field_type, geometry_index, geometry_type)")
def geo_table_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a decoded table's schema says about its columns."""
    rows = customers(spark, sf_dir)
    lines = rows.select(encode.feature_json(rows, ["c_custkey", "c_name", "c_acctbal"], "pt", "POINT").alias("value"))
    schema = decode.features_from_lines(lines, customer_info(), geometry_name="where").schema
    return spark.createDataFrame([(i, f.name, f.metadata.get("type"), f.metadata.get("index"), f.metadata.get("geometryType")) for i, f in enumerate(schema)], "position int, name string, field_type string, geometry_index int, geometry_type string")


@query("SELECT * FROM (VALUES ('bigint', true), ('string', true), ('double', true), ('timestamp', true), ('binary', true), ('array<int>', false), ('map<string,int>', false), ('struct<a:int>', false)) AS v(type, accepted)")
def attribute_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which column types can be attributes."""

    def accepted(kind: str) -> bool:
        try:
            encode.check_attributes(spark.createDataFrame([], f"a {kind}").schema, ["a"])
        except (TypeError, ValueError):
            return False
        return True

    return spark.createDataFrame([(k, accepted(k)) for k in ("bigint", "string", "double", "timestamp", "binary", "array<int>", "map<string,int>", "struct<a:int>")], "type string, accepted boolean")


# --- places ---------------------------------------------------------------------


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as places in two categories: their nation and their market segment."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = customers(spark, sf_dir).join(F.broadcast(nation), "c_nationkey")  # nations: a fixed 25
    category = lambda i, label: F.struct(i.cast("string").alias("categoryId"), label.alias("label"))
    return rows.select(
        F.concat(F.lit("p"), "c_custkey").alias("placeId"), F.col("c_name").alias("name"), F.struct(F.col("pt")[0].alias("x"), F.col("pt")[1].alias("y")).alias("location"),
        F.array(category(F.col("c_nationkey") + 10000, F.col("n_name")), category(F.length("c_mktsegment") + 20000, F.col("c_mktsegment"))).alias("categories"), "c_acctbal",
    )


_PLACES = f"""(SELECT 'p' || c_custkey AS place_id, c_name AS name, {_LON} AS x, {_LAT} AS y, CAST(c_nationkey + 10000 AS VARCHAR) AS c1, n_name AS l1,
 CAST(length(c_mktsegment) + 20000 AS VARCHAR) AS c2, c_mktsegment AS l2, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
_DISTANCE = "2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(y - 20) / 2), 2) + cos(radians(20)) * cos(radians(y)) * pow(sin(radians(x - 15) / 2), 2))))"


@query(f"SELECT place_id, x, y FROM {_PLACES} WHERE x BETWEEN -60 AND 60 AND y BETWEEN -30 AND 45 AND (c1 IN ('10003', '20008') OR c2 IN ('10003', '20008'))")
def places_within_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.within_extent(places(spark, sf_dir), -60.0, -30.0, 60.0, 45.0, ["10003", "20008"]).select(F.col("placeId").alias("place_id"), "location.x", "location.y")


@query(f"SELECT place_id FROM {_PLACES} WHERE (x >= 170 OR x <= -170) AND y BETWEEN -90 AND 90")
def places_across_antimeridian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.within_extent(places(spark, sf_dir), 170.0, -90.0, -170.0, 90.0).select(F.col("placeId").alias("place_id"))


@query(f"SELECT place_id, round(d, 1) AS distance FROM (SELECT *, {_DISTANCE} AS d FROM {_PLACES}) WHERE d <= 3000000")
def places_near_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.near_point(places(spark, sf_dir), 15.0, 20.0, 3_000_000.0).select(F.col("placeId").alias("place_id"), F.round("distance", 1).alias("distance"))


@query(f"SELECT place_id, round(d, 1) AS distance FROM (SELECT *, {_DISTANCE} AS d FROM {_PLACES}) WHERE d <= 9000000 ORDER BY d, place_id LIMIT 10")
def places_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = P.near_point(places(spark, sf_dir), 15.0, 20.0, 9_000_000.0)
    return P.nearest(near, 10).select(F.col("placeId").alias("place_id"), F.round("distance", 1).alias("distance"))


@query(f"SELECT place_id FROM {_PLACES} WHERE contains(lower(name), 'build') OR contains(lower(l1), 'build') OR contains(lower(l2), 'build')")
def places_search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.within_extent(places(spark, sf_dir), -180.0, -90.0, 180.0, 90.0, search_text="BUILD").select(F.col("placeId").alias("place_id"))


@query(f"SELECT place_id, CAST(floor((r - 1) / 25) + 1 AS INTEGER) AS page, CAST((r - 1) % 25 + 1 AS INTEGER) AS page_row FROM (SELECT place_id, row_number() OVER (ORDER BY d, place_id) AS r FROM (SELECT *, {_DISTANCE} AS d FROM {_PLACES}) WHERE d <= 6000000)")
def places_paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = P.near_point(places(spark, sf_dir), 15.0, 20.0, 6_000_000.0)
    return P.pages(near, 25).select(F.col("placeId").alias("place_id"), "page", "page_row")


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types as a hierarchy: each type is a category, its first word the parent."""
    types = table(spark, sf_dir, "part").select("p_type").distinct()
    labels = F.split("p_type", " ")
    return types.select(F.col("p_type").alias("categoryId"), labels.alias("fullLabel"), F.array(labels[0]).alias("parents"))


@query("SELECT DISTINCT p_type AS category_id FROM part WHERE len(list_filter(string_split(p_type, ' '), lambda w: contains(lower(w), 'anda'))) > 0")
def categories_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.filter_categories(categories(spark, sf_dir), "ANDA").select(F.col("categoryId").alias("category_id"))


@query("SELECT DISTINCT p_type AS category_id, 'icon-svg' AS icon_url, 'petit' AS label FROM part WHERE string_split(p_type, ' ')[1] = 'ECONOMY'")
def category_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = P.child_categories(categories(spark, sf_dir), "ECONOMY")
    icons = F.create_map(F.lit("svg"), F.lit("icon-svg"), F.lit("png"), F.lit("icon-png"))
    labels = F.create_map(F.lit("fr"), F.lit("petit"), F.lit("en"), F.lit("small"))
    return children.select(F.col("categoryId").alias("category_id"), P.icon(icons, "svg")["url"].alias("icon_url"), P.in_language(labels, "fr-CA").alias("label"))


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(spark, sf_dir).select(
        "placeId", "name", "location", "categories",
        F.struct(F.lit("Street 1").alias("streetAddress"), F.col("categories")[0]["label"].alias("country"), F.lit(None).cast("string").alias("region")).alias("address"),
        F.struct(F.when(F.col("c_acctbal") < 0, "cheap").otherwise("expensive").alias("price"), (F.abs("c_acctbal") % 5).alias("user")).alias("rating"),
    )


@query(f"SELECT place_id, l1 AS country, CASE WHEN c_acctbal < 0 THEN 'cheap' ELSE 'expensive' END AS price, 2 AS n_address, 3 AS n_columns FROM {_PLACES} WHERE place_id IN ('p1', 'p7', 'p77')")
def place_details_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = P.place_details(details(spark, sf_dir), ["p1", "p7", "p77", "none"], ["address:streetAddress", "address:country", "rating"])
    n = len(got.columns)
    return got.select(F.col("placeId").alias("place_id"), "address.country", "rating.price", F.lit(len(got.schema["address"].dataType.fields)).alias("n_address"), F.lit(n).alias("n_columns"))


def _rest(spark: SparkSession, operation: str, **options: str) -> DataFrame:
    """The paged service as a data source, against an invented service that needs no network."""
    from ..sources.places_api import PlacesDataSource

    spark.dataSource.register(PlacesDataSource)
    return spark.read.format("places").options(operation=operation, baseUrl="https://places.invalid/v1", token="canned", fetcher="meridia.plans.canned:fetch", **options).load()


@query("SELECT * FROM (VALUES " + ", ".join(f"('c{i}', 'Canned {i}', CAST({10 + i} AS DOUBLE), '{10000 + i % 3}')" for i in (1, 4, 7)) + ") AS v(place_id, name, x, category_id)")
def places_rest_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _rest(spark, "within-extent", xmin="0", ymin="0", xmax="90", ymax="90", categoryIds="10001")
    return got.select(F.col("placeId").alias("place_id"), "name", "location.x", F.col("categories")[0]["categoryId"].alias("category_id"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('c{i}', 'Canned {i}', CAST({10 + i} AS DOUBLE), '{('Cafe', 'Stadium', 'Office')[i % 3]}', CAST(NULL AS VARCHAR))" for i in (3, 5)) + ") AS v(place_id, name, x, category, description)")
def places_rest_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _rest(spark, "place-details", searches='[{"placeId": "c3"}, {"placeId": "c5"}]', requestedFields="name,location,categories")
    return got.select(F.col("placeId").alias("place_id"), "name", "location.x", F.col("categories")[0]["label"].alias("category"), "description")


@query("SELECT * FROM (VALUES ('10002', 'Places', 'Office')) AS v(category_id, top, label)")
def places_rest_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rest(spark, "categories", filter="off").select(F.col("categoryId").alias("category_id"), F.col("fullLabel")[0].alias("top"), F.col("fullLabel")[1].alias("label"))


@query("SELECT * FROM (VALUES ('10001', 'Stadium', CAST(NULL AS VARCHAR))) AS v(category_id, label, icon_url)")
def places_rest_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rest(spark, "category-details", categoryId="10001").select(F.col("categoryId").alias("category_id"), F.col("fullLabel")[1].alias("label"), F.col("icon.url").alias("icon_url"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('c{i}', 'Canned {i}', CAST({10 + i} AS DOUBLE), CAST({100 * i} AS DOUBLE), '{10000 + i % 3}')" for i in range(1, 6)) + ") AS v(place_id, name, x, distance, category_id)")
def places_rest_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _rest(spark, "near-point", x="10", y="50", radius="500")
    return got.select(F.col("placeId").alias("place_id"), "name", "location.x", "distance", F.col("categories")[0]["categoryId"].alias("category_id"))
