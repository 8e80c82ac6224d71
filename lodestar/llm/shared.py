"""Working tables in the folder that all executors share, and text columns made safe."""

from __future__ import annotations

import gc
import mmap
import os
import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


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
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove working tables of cut or small that nothing will read again, and have Spark clear the shuffles that led to them."""
    for path in {getattr(df, "working_path", None) for df in tables} - {None}:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    gc.collect()
    spark._jvm.System.gc()  # what is no longer referred to has its shuffle files removed


def stored_at(df: DataFrame, path: str) -> DataFrame:
    """df, and that it reads the working table at path."""
    df.working_path = path
    return df


def cut(df: DataFrame, name: str, **options: Any) -> DataFrame:
    """The rows of df, written once, with options of the writer, and read again: its lineage ends at the written table."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return stored_at(df.sparkSession.read.schema(df.schema).parquet(path), path)


#: Rows and bytes on disk of ids or terms that a join sends to all workers at most; more are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 16_000_000


def small(df: DataFrame) -> DataFrame:
    """df, written and, if its rows and bytes allow it, marked for broadcast."""
    spark, df = df.sparkSession, cut(df, "wanted")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(df.working_path)
    size = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(hadoop).getLength()
    if size <= BROADCAST_BYTES and df.count() <= BROADCAST_ROWS:
        return stored_at(F.broadcast(df), df.working_path)
    return df


def fresh(name: str, taken: list[str]) -> str:
    """A column name like name that is none of those taken, in any case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_state(name: str, make: Callable[[], Any]) -> Any:
    """An object that a Python worker keeps from one task to the next: a cache, never a result."""
    held = sys.modules.setdefault("lodestar_worker_state", types.ModuleType("lodestar_worker_state")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]


def local_path(path: str) -> str | None:
    """The path on a mounted file system, None for any other store."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if path.startswith("/") else None


def put_file(path: str, data: bytes) -> None:
    """Write a file from a worker; a task that runs again puts the same file anew."""
    local = local_path(path)
    if local is None:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        store.create_dir(inner.rsplit("/", 1)[0])
        with store.open_output_stream(inner) as out:
            out.write(data)
        return
    os.makedirs(os.path.dirname(local), exist_ok=True)
    part = f"{local}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        out.write(data)
    os.replace(part, local)


def map_file(path: str) -> mmap.mmap | bytes:
    """A file's bytes, memory-mapped. A file of a store that isn't mounted is first copied to a nameless local one."""
    local = local_path(path)
    if local is not None:
        with open(local, "rb") as file:
            return mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    with tempfile.TemporaryFile() as file, store.open_input_stream(inner) as source:
        while part := source.read(1 << 24):
            file.write(part)
        file.flush()
        return mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
