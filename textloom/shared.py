"""Files that the driver and all executors can see."""

from __future__ import annotations

import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; a local one only where that is unset and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "textloom-shared")
    return f"{named.rstrip('/')}/textloom-{name}-{uuid.uuid4().hex}"


def create_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """A file with this text, whole or not at all; False, and nothing is changed, if the path exists.

    Of several writers one gets True: the text is written aside and then named by a step that fails where
    the name is taken (a link on a local disk, elsewhere a rename without overwriting, which HDFS does atomically; a
    store that copies to rename does not).
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(conf)
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_draft-{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(text, "utf-8"))
    out.close()
    try:
        if files.getScheme() == "file":
            local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(local(target), local(draft))
        else:
            how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            how[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf).rename(draft, target, how)
        return True
    except Py4JJavaError as why:
        if "FileAlreadyExistsException" not in why.java_exception.getClass().getName():
            raise
        return False
    finally:
        files.delete(draft, False)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder that this program wrote."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
