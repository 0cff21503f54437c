"""Shared folder handling, bounded Arrow batches and small column helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and RE2 spelling of one word of a text (anything but ASCII white space).
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of one Arrow batch sent to a Python worker; texts can be megabytes long.
BATCH_BYTES = 8 << 20
#: Keys that ``join_unique`` broadcasts at most, and rows of one key that it never splits.
FREQUENT_KEYS, FREQUENT_ROWS = 100_000, 256
#: Folders made for local sessions, by application; they go when the process ends.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, as the cluster names it in spark.checkpoint.dir.

    Where that setting is absent, a local master gets a temporary folder of its own;
    any other master is refused, because executors would not see the driver's disk.
    """
    context = spark.sparkContext
    if found := spark.conf.get("spark.checkpoint.dir", None):
        # With its scheme, as a plain path means the cluster's default file system.
        path = context._jvm.org.apache.hadoop.fs.Path(found)
        return path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="meridia-")
        atexit.register(shutil.rmtree, _own[context.applicationId], ignore_errors=True)
    return _own[context.applicationId]


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared one, in the application's own folder."""
    return f"{shared_dir(spark)}/meridia/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clean_work(spark: SparkSession) -> None:
    """Removes all work folders of this application, when none of their results is needed any more."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/meridia/{context.applicationId}")
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet below the shared folder and rereads it.

    Cuts the lineage: what follows depends on files that outlive any executor.
    """
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_unique(many: DataFrame, one: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """Inner join with a table of unique, non-null keys whose column ``count`` says how many rows of ``many`` each has.

    Frequent keys would land in one task each, so they are broadcast: those over a share of
    all rows of which at most FREQUENT_KEYS keys can have so many. The rest are shuffled.
    Both tables are read twice, so they should be written ones.
    """
    total = one.agg(F.sum(count)).first()[0] or 0
    frequent = F.col(count) > max(FREQUENT_ROWS, total // FREQUENT_KEYS)
    large, small = one.filter(frequent).drop(count), one.filter(~frequent).drop(count)
    by_broadcast = many.join(F.broadcast(large), keys)
    by_shuffle = many.join(F.broadcast(large.select(keys)), keys, "left_anti").join(small, keys)
    return by_broadcast.unionByName(by_shuffle)


def bounded_batches(spark: SparkSession) -> None:
    """Limits Arrow batches by bytes and not by rows alone, so that long texts fit.

    Plans read the setting when they run, so it stays in the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def local_path(uri: str) -> str | None:
    """The path of a file URI or plain path, None for other file systems."""
    if uri.startswith("file:"):
        uri = uri[5:]
        return "/" + uri.lstrip("/")
    return None if "://" in uri else uri


def write_bytes(uri: str, name: str, data: bytes) -> str:
    """Writes one file whole or not at all; one of the same name is replaced."""
    target, draft = f"{uri}/{name}", f"{uri}/.{name}.{uuid.uuid4().hex}"
    if (path := local_path(target)) is not None:
        os.makedirs(local_path(uri), exist_ok=True)
        with open(local_path(draft), "wb") as f:
            f.write(data)
        os.replace(local_path(draft), path)
        return target
    from pyarrow.fs import FileSystem

    fs, base = FileSystem.from_uri(uri)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/.{os.path.basename(draft)}") as f:
        f.write(data)
    from pyarrow.fs import FileType

    if fs.get_file_info(f"{base}/{name}").type != FileType.NotFound:
        fs.delete_file(f"{base}/{name}")  # not every store moves onto a file that is there
    fs.move(f"{base}/.{os.path.basename(draft)}", f"{base}/{name}")
    return target


def attempt_name() -> str:
    """Of the running task's partition and attempt: no two attempts write the same files."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return f"{context.partitionId():06d}-{context.taskAttemptId()}"


def open_bytes(uri: str):
    """A seekable binary reader."""
    if (path := local_path(uri)) is not None:
        return open(path, "rb")
    from pyarrow.fs import FileSystem

    fs, path = FileSystem.from_uri(uri)
    return fs.open_input_file(path)
