"""Incremental indexing: a file stream of chunks, upserted batch by batch; the checkpoint says what is done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar import schemas
from lodestar.functions.storage import exists
from lodestar.operators.enrich import upserted
from lodestar.sources.buckets import BucketedIndex

#: Versions that stay: the newest, and the one before it for those who read it still.
VERSIONS_KEPT = 2


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of the index that were written to their end, ascending."""
    if not exists(spark, path):
        return []
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and exists(spark, f"{path}/{n}/_SUCCESS"))


def upsert_batch(path: str, key: str = "chunk_id"):
    """foreachBatch function: the index is a series of versions, each complete; readers take the newest.

    A batch is upserted into the newest version, whatever its epoch, so one that runs again, or a new
    checkpoint over an older index, changes nothing that was there. A later batch without any version is an error.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        known = versions(spark, path)
        if epoch and not known:
            raise ValueError(f"batch {epoch} finds no index of the batches before it at {path}")
        version = known[-1] + 1 if known else 0
        new = batch.withColumn("version", F.lit(version).cast("long"))
        new = upserted(spark.read.parquet(f"{path}/v={known[-1]}") if known else new.limit(0), new, key, "version")
        new.write.mode("overwrite").parquet(f"{path}/v={version}")
        for old in known[: 1 - VERSIONS_KEPT]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={old}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

    return run


def index_stream(spark: SparkSession, source: str, path: str, checkpoint: str, schema=schemas.CHUNK) -> StreamingQuery:
    """Take up all files of source that are new, and stop."""
    rows = spark.readStream.schema(schema).json(source)
    return rows.writeStream.foreachBatch(upsert_batch(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of the index; an error where there is none."""
    known = versions(spark, path)
    if not known:
        raise ValueError(f"no index at {path}")
    return spark.read.parquet(f"{path}/v={known[-1]}").drop("version")


def bucketed_stream(spark: SparkSession, source: str, index: BucketedIndex, checkpoint: str, name: str, schema=schemas.CHUNK, order: str | None = None) -> StreamingQuery:
    """Take up all files of source that are new, and stop. A batch rewrites the buckets of its keys only; name tells this stream's
    batches from those of others, so one that runs again after the switch does nothing.
    """
    rows = spark.readStream.schema(schema).json(source)
    put = lambda batch, epoch: index.upsert(batch, order, (name, epoch))
    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
