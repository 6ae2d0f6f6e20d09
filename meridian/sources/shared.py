"""The folder that the driver and all executors share, and files in it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of this machine, which only a
    session in local mode may use."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="meridian-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return "file://" + _own[0]


def new_folder(spark: SparkSession, name: str) -> str:
    """The URI of a folder, as yet without files, whose scheme Arrow knows."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}")
    uri = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a URI or a plain path, and the path in it."""
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), os.path.abspath(uri))


def make_parent(uri: str) -> tuple[fs.FileSystem, str]:
    system, path = file_system(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system, path


def scratch(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: they are made once, keep
    their partitions' marks, and outlive lost executors. The folder goes when the driver ends."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session has ended; the cluster clears the folder
        pass
