import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from meridia.operators import decode, encode
from meridia.plans import queries as plans

from .conftest import DATA

COLUMN_SETS = ("linestring", "multipolygon", "multilinestring", "polygon", "point")


@pytest.mark.parametrize(("range_rows", "page_bytes"), [(8, 500), (64, 1), (1 << 30, 1 << 30)])
@pytest.mark.parametrize("by", [["k"], []])
def test_pages_hold_the_whole_set(spark, monkeypatch, range_rows, page_bytes, by):
    """Also with groups and order keys that are null, equal keys, repeated rows, and groups of a few rows and of many."""
    monkeypatch.setattr(encode, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(encode, "PAGE_BYTES", page_bytes)
    rows = [(None if i % 7 == 0 else "few" if i % 97 == 1 else "many", None if i % 50 == 0 else i // 3 - 100, [float(i % 1000), None if i % 11 == 0 else 0.5]) for i in range(1500)]
    df = spark.createDataFrame(rows + rows[:40], "k string, o long, pt array<double>").repartition(5)
    whole = {r[0] if by else None: json.loads(r.featureset) for r in encode.feature_set_json(df, ["o"], "pt", "POINT", order_by="o", by=by).collect()}
    pages = encode.feature_set_pages(df, ["o"], "o", "pt", "POINT", by=by).collect()
    for k, expected in whole.items():
        got = []
        for page in sorted((p for p in pages if not by or p.k == k), key=lambda p: p.start):
            made = json.loads(page.featureset)
            assert page.start == len(got) and {**made, "features": 0} == {**expected, "features": 0}
            assert sum(len(json.dumps(f, separators=(",", ":"))) for f in made["features"][:-1]) < page_bytes
            got += made["features"]
        assert got == expected["features"]
    assert len(pages) == len(whole) if page_bytes == 1 << 30 else len(pages) > 100


@pytest.mark.parametrize("shape", COLUMN_SETS)
def test_column_sets_are_read_in_pages(spark, monkeypatch, tmp_path, shape):
    """No text of a whole set is read at once, and none goes on with its features."""
    monkeypatch.setattr(encode, "RANGE_ROWS", 16, raising=False)
    monkeypatch.setattr(encode, "PAGE_BYTES", 5000, raising=False)
    once = spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet")
    label = F.when(F.col("label") > 3, 4).when(F.col("label") > 0, F.col("label")).cast("int")
    df = once.withColumn("i", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select((F.col("vec_id") + F.col("i") * 1000).alias("vec_id"), "embedding", label.alias("label"))
    df.repartition(3, "embedding").write.parquet(str(tmp_path / "embeddings.parquet"))
    read = []

    def explode(texts, *args, f=decode.explode_features, **options):
        read.append((texts, options["keep"]))
        return f(texts, *args, **options)

    monkeypatch.setattr(decode, "explode_features", explode)
    name = f"column_set_{shape}"
    got = plans.queries()[name](spark, str(tmp_path))
    ((texts, kept),) = read
    assert "featureset" not in kept
    assert texts.agg(F.max(F.octet_length("featureset"))).first()[0] < 10000
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{os.path.join(tmp_path, 'embeddings.parquet', '*.parquet')}')")
    expected = con.execute(plans.oracle_sql()[name])
    names = [d[0] for d in expected.description]
    rows = got.select(names).collect()
    assert len(rows) == 1500 and sorted(map(repr, map(tuple, rows))) == sorted(map(repr, expected.fetchall()))
