import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from meridia import types
from meridia.operators import places as P
from meridia.plans import canned
from meridia.sources import places_api as A


@pytest.fixture(scope="module")
def places(spark):
    rows = [("a", "Cafe One", 139.745, 35.655, "17117", "Bicycle Store"), ("b", "Edge", 139.74, 35.65, "10051", "Stadium"), ("c", "Far", 10.0, 10.0, "17119", "Bicycle Store"), ("d", None, 179.9, 0.0, None, None)]
    df = spark.createDataFrame(rows, "placeId string, name string, x double, y double, categoryId string, label string")
    return df.select("placeId", "name", F.struct("x", "y").alias("location"), F.when(F.col("categoryId").isNotNull(), F.array(F.struct("categoryId", "label"))).alias("categories"))


def ids(df):
    return sorted(r.placeId for r in df.collect())


def test_extent(places):
    extent = (139.74, 35.65, 139.75, 35.66)
    assert ids(P.within_extent(places, *extent)) == ["a", "b"]
    assert ids(P.within_extent(places, *extent, category_ids=["17117", "17119"])) == ["a"]
    assert ids(P.within_extent(places, *extent, search_text="STADIUM")) == ["b"]
    assert ids(P.within_extent(places, 170.0, -10.0, -170.0, 10.0)) == ["d"]


def test_near_point(places):
    near = P.near_point(places, 139.745, 35.655).collect()
    assert [(r.placeId, round(r.distance)) for r in sorted(near, key=lambda r: r.distance)] == [("a", 0), ("b", 716)]
    assert ids(P.near_point(places, -179.95, 0.0, 20_000.0)) == ["d"]
    assert ids(P.near_point(places, 0.0, 89.9, 2e7)) == ["a", "b", "c", "d"]


def test_limits(places):
    for call in (lambda: P.within_extent(places, 0, 0, 1, 1, category_ids=["x"] * 11), lambda: P.within_extent(places, 0, 0, 1, 1, search_text="x" * 256), lambda: P.filter_categories(places, "of"), lambda: P.icon(F.lit(None), "gif"), lambda: P.project_fields(places, ["rating"])):
        with pytest.raises(ValueError, match="."):
            call()


def test_categories_and_languages(spark):
    df = spark.createDataFrame([("1", ["Office"], []), ("2", ["Food", "Coffee"], ["1"]), ("3", ["Park"], ["2", "1"])], "categoryId string, fullLabel array<string>, parents array<string>")
    by = lambda x: sorted(r.categoryId for r in x.collect())
    assert by(P.filter_categories(df, "off")) == ["1", "2"] and by(P.child_categories(df, "1")) == ["2", "3"] and by(P.category_details(df, "3")) == ["3"] and by(P.filter_categories(df)) == ["1", "2", "3"]
    labels = F.create_map(F.lit("fr"), F.lit("F"), F.lit("en"), F.lit("E"))
    assert df.select(P.in_language(labels, "fr-CA"), P.in_language(labels, "de")).first()[:] == ("F", "E")


def test_requests():
    url = A.SearchParams("near-point", {"x": 1, "y": 2, "categoryIds": ["a", "b"], "searchText": "a b"}).url("https://h/v1/")
    assert url == "https://h/v1/places/near-point?x=1&y=2&categoryIds=a%2Cb&searchText=a+b&f=json"
    assert A.SearchParams("category-details", {"categoryId": "a/b", "icon": "svg"}).url("https://h") == "https://h/categories/a%2Fb?icon=svg&f=json"
    assert "requestedFields=all" in A.SearchParams("place-details", {"placeId": "p"}).url("https://h")
    for operation, values in (("near-point", {"x": 1}), ("nowhere", {})):
        with pytest.raises(ValueError, match="."):
            A.SearchParams(operation, values)


def test_paging_goes_past_an_empty_page():
    pages = {"1": {"results": [1, 2], "pagination": {"nextUrl": "2"}}, "2": {"results": [], "pagination": {"nextUrl": "3"}}, "3": {"results": [3]}}
    got = A.search_pages(lambda url, h: (200, json.dumps(pages[url])), "1", None)
    assert [x for p in got for x in p["results"]] == [1, 2, 3]
    with pytest.raises(A.PlacesError):
        list(A.search_pages(lambda url, h: (200, '{"pagination":{"nextUrl":"1"}}'), "1", None))


def test_errors_and_retries():
    with pytest.raises(A.PlacesError, match="498") as e:
        A.fetch_json(canned.fetch, "https://h/categories", "secret", 0, 0)
    assert e.value.code == 498 and "secret" not in str(e.value)
    answers = iter([(500, "oops"), OSError("gone"), (200, '{"a":1}')])

    def fetch(url, headers):
        if isinstance(x := next(answers), OSError):
            raise x
        return x

    assert A.fetch_json(fetch, "u", None, 3, 0) == {"a": 1}
    with pytest.raises(A.PlacesError, match="not JSON"):
        A.fetch_json(lambda u, h: (200, "<html>"), "u", None, 0, 0)
    with pytest.raises(OSError, match="down"):
        A.fetch_json(lambda u, h: (_ for _ in ()).throw(OSError("down")), "u", None, 1, 0)


@pytest.mark.parametrize(
    ("options", "column", "expected"),
    [
        ({"operation": "near-point", "x": "0", "y": "0"}, "placeId", [f"c{i}" for i in range(1, 8)]), ({"operation": "within-extent", "xmin": "0", "ymin": "0", "xmax": "9", "ymax": "9", "categoryIds": "10001"}, "placeId", ["c1", "c4", "c7"]),
        ({"operation": "place-details", "placeId": "c3"}, "name", ["Canned 3"]), ({"operation": "categories", "filter": "off"}, "categoryId", ["10002"]), ({"operation": "category-details", "categoryId": "10001"}, "categoryId", ["10001"]),
        ({"operation": "near-point", "searches": json.dumps([{"x": 0, "y": 0, "radius": 100}, {"x": 0, "y": 0, "radius": 200}])}, "placeId", ["c1", "c1", "c2"]),
    ],
)
def test_data_source(spark, options, column, expected):
    spark.dataSource.register(A.PlacesDataSource)
    got = spark.read.format("places").options(baseUrl="https://h/v1", token="canned", fetcher="meridia.plans.canned:fetch", **options).load()
    assert sorted(r[column] for r in got.collect()) == expected


def test_data_source_errors(spark):
    spark.dataSource.register(A.PlacesDataSource)
    reader = spark.read.format("places").options(baseUrl="https://h/v1", fetcher="meridia.plans.canned:fetch", retries="0")
    with pytest.raises(PySparkException, match="498"):
        reader.options(operation="categories").load().collect()
    with pytest.raises(PySparkException):
        spark.read.format("places").load()


def test_schemas_match_the_records():
    assert types.columns_of("struct<a:int,b:struct<c:int,d:array<int>>>") == "a int,b struct<c:int,d:array<int>>"
