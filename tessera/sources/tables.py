"""Readers of the input tables and the shared place for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the input folder, by a path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: folders of local sessions without the setting, by application
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that driver and executors share (``spark.checkpoint.dir``).

    Everything an application stages lies below it, so its owner can remove the folder once results are saved
    (``drop_staged``). Only a local session without the setting, as in tests, gets a folder of its machine; on a
    cluster a missing setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is not set: tables must be staged in a folder that all executors see")
        found = _own.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="spark-shared-")
        _own[spark.sparkContext.applicationId] = found
    return f"{found}/{spark.sparkContext.applicationId}"


def file_system(spark: SparkSession, path: str):  # noqa: ANN201
    """(the file system of a path, the path in its terms): whatever store Spark itself writes to."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    fs, at = file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename into place, once: an existing target is an error."""
    fs, to = file_system(spark, target)
    fs.mkdirs(to.getParent())
    if fs.exists(to) or not fs.rename(file_system(spark, source)[1], to):
        raise FileExistsError(f"{target} is there already, or {source} is not")


def remove(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


#: tables that the session's catalog knows by name, by application
_named: dict[str, list[str]] = {}


def staged_buckets(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """``df`` in a table of the shared folder bucketed by a column: a join on it moves only the other side.

    The session's catalog knows it by a unique name until ``drop_staged``.
    """
    spark, name = df.sparkSession, f"staged_{uuid.uuid4().hex}"
    _named.setdefault(spark.sparkContext.applicationId, []).append(name)
    df.repartition(buckets, column).write.bucketBy(buckets, column).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def drop_staged(spark: SparkSession) -> None:
    """Remove what this application has staged, names in the catalog included. DataFrames made from it cannot be read any more: save results first."""
    for name in _named.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"drop table if exists {name}")
    remove(spark, shared_dir(spark))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it again, at once: operators that stage run jobs when they are called.

    Cuts the lineage in a way that survives the loss of executors: later stages read files that every
    executor sees instead of recomputing the work above.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
