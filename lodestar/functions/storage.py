"""Tables written once and read again in a folder that the driver and all executors share, and files put in place whole or not at all."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes on disk of a table that is sent to all workers at most; a larger one is joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 16_000_000


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path)
    return fs.exists(p)


def size_bytes(spark: SparkSession, path: str) -> int:
    fs, p = hadoop_path(spark, path)
    return fs.getContentSummary(p).getLength()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none where there is no folder."""
    fs, p = hadoop_path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = hadoop_path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that nobody has seen in part: to another name first, then renamed. False if one of that name is there already."""
    fs, p = hadoop_path(spark, path)
    fs.mkdirs(p.getParent())
    part = spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex}")
    stream = fs.create(part, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if fs.getScheme() == "file":  # a link is made in one step, and fails where the name is taken
        try:
            os.link(part.toUri().getPath(), p.toUri().getPath())
        except FileExistsError:
            return False
        finally:
            fs.delete(part, False)
        return True
    files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    modes = spark.sparkContext._gateway.new_array(rename, 1)
    modes[0] = rename.NONE
    try:
        files.rename(part, p, modes)
    except Exception:
        fs.delete(part, False)
        if not fs.exists(p):
            raise
        return False
    return True


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset a local session gets one of its own, any other an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            base = known.get()
        elif re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            base = "file://" + tempfile.mkdtemp(prefix="lodestar-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path not used before, deleted when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/lodestar/{name}-{uuid.uuid4().hex}"
    fs, p = hadoop_path(spark, path)
    fs.deleteOnExit(p)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once and read again: whatever reads them from here on doesn't work them out anew."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.working_path = path
    return out


def clear_shuffles(spark: SparkSession) -> None:
    """Have Spark remove the files of shuffles that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def small(df: DataFrame) -> DataFrame:
    """df, written, and marked for broadcast if its rows and its bytes allow it."""
    out = cut(df, "side")
    if size_bytes(df.sparkSession, out.working_path) <= BROADCAST_BYTES and out.count() <= BROADCAST_ROWS:
        return F.broadcast(out)
    return out
