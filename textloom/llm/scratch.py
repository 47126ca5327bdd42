"""Lineage cuts in the folder that all executors share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the cluster names it; a local one only where it is unset and all runs on one machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "textloom-shared")
        spark.sparkContext.setCheckpointDir(named)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    The written table replaces the lineage, so a lost executor costs only the
    tasks that ran on it, and later passes read just the columns they need.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` wrote and nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shrink_driver(spark: SparkSession) -> None:
    """Ask the driver to collect its garbage, that of the JVM and that of Python, and to give the memory back to the system."""
    gc.collect()
    spark._jvm.System.gc()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shrink_heaps(spark: SparkSession) -> None:
    """Ask every executor, and the driver, to collect its garbage, which gives the heap that earlier stages had grown back to the system.

    Python workers share the executors' memory with that heap and cannot have what it holds.
    """
    shrink_driver(spark)
    tasks = max(2 * spark.sparkContext.defaultParallelism, 2)
    spark.range(0, tasks, 1, tasks).selectExpr("java_method('java.lang.System', 'gc') AS done").write.format("noop").mode("overwrite").save()
