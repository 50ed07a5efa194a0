"""Intermediate tables in the folder that driver and executors share (spark.checkpoint.dir), which cut lineage."""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="redactica-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def file_system(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def folder(spark: SparkSession, name: str) -> str:
    """A new path, deleted when the application ends. Without the setting a local session gets a folder of its own; a cluster, whose
    machines see different disks, is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{_own_dir()}"
    path = f"{root.rstrip('/')}/redactica/{name}-{uuid.uuid4().hex}"
    file_system(spark, path).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table, written once and read again."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
