import os

import pytest

from meridia.llm import common


def test_shared_folder(spark, tmp_path):
    assert common.local_path(common.shared_dir(spark)) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert common.work_dir(spark, "a") != common.work_dir(spark, "a")


def test_own_folder_only_for_local_masters(monkeypatch):
    class Context:
        applicationId, master = "app", "local[2]"

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    folder = common.shared_dir(Session())
    assert os.path.isdir(folder) and common.shared_dir(Session()) == folder
    monkeypatch.setattr(Context, "master", "spark://host:7077")
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        common.shared_dir(Session())


def test_files_are_written_whole(tmp_path):
    uri = f"file://{tmp_path}/x"
    for data in (b"one", b"two"):
        path = common.write_bytes(uri, "f", data)
        with common.open_bytes(path) as f:
            assert f.read() == data
    assert os.listdir(tmp_path / "x") == ["f"]


def test_materialised_tables_keep_their_schema(spark):
    df = spark.createDataFrame([(1, None)], "a long, b array<string>")
    again = common.materialize(df, "t")
    assert again.dtypes == df.dtypes and again.collect() == df.collect()


def test_work_folders_can_be_removed(spark):
    kept = common.materialize(spark.range(3), "kept")
    folder = common.local_path(common.shared_dir(spark)) + f"/meridia/{spark.sparkContext.applicationId}"
    assert kept.count() == 3 and any(name.startswith("kept-") for name in os.listdir(folder))


def test_frequent_keys_join_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    many = spark.range(500).select(F.when(F.col("id") < 300, 7).otherwise(F.col("id") % 40).cast("long").alias("k"), F.col("id").alias("v"))
    one = many.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top")).filter("k <> 3")
    expected = sorted(many.join(one.drop("n"), "k").collect())
    for rows in (0, 20, 256, 1000):
        monkeypatch.setattr(common, "FREQUENT_ROWS", rows)
        found = common.join_unique(many, one, ["k"])
        assert found.columns == ["k", "v", "top"] and sorted(found.collect()) == expected
    assert common.join_unique(many.limit(0), one.limit(0), ["k"]).count() == 0
