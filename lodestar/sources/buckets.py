"""An index in hash buckets of its key. An upsert rewrites the buckets that it touches, and a manifest then switches to them at once."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestar.functions.storage import cut, delete, names
from lodestar.sources.log import Log

BUCKETS, ATTEMPTS = 64, 5
#: Manifests that stay: the newest and those before it for readers that hold one still.
KEPT = 2
#: The column that names a row's bucket in the files.
BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Other writers were first each time."""


@dataclass(frozen=True)
class BucketedIndex:
    """Rows of one key each below path: data/<folder>/_bucket=<n>, and manifests that say which folder has each bucket."""

    spark: SparkSession
    path: str

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, key: str, buckets: int = BUCKETS) -> BucketedIndex:
        """An empty index; one that is there already is an error."""
        if key not in schema.names or BUCKET in schema.names or buckets < 1:
            raise ValueError(f"an index needs a column {key}, none named {BUCKET} and a bucket at least")
        first = {"key": key, "buckets": buckets, "schema": schema.json(), "folders": {}, "epochs": {}}
        if not Log(spark, f"{path}/manifests").put(0, first):
            raise ValueError(f"there is an index at {path}")
        return cls(spark, path)

    @property
    def log(self) -> Log:
        return Log(self.spark, f"{self.path}/manifests")

    def manifest(self, version: int | None = None) -> tuple[int, dict]:
        """The version asked for, or the newest."""
        found = self.log.latest() if version is None else (version, self.log.at(version)) if version in self.log.numbers() else None
        if found is None:
            raise ValueError(f"no index at {self.path}" if version is None else f"no version {version} at {self.path}")
        return found

    def rows(self, manifest: dict, buckets: set[int] | None = None) -> DataFrame:
        """The rows of some buckets or all, read from these alone."""
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        paths = [f"{self.path}/data/{folder}/{BUCKET}={b}" for b, folder in manifest["folders"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self.rows(self.manifest(version)[1])

    def bucket(self, manifest: dict) -> Column:
        return F.pmod(F.xxhash64(F.col(manifest["key"])), F.lit(manifest["buckets"])).cast("int")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of keys (key). Only the buckets of these are read."""
        manifest = self.manifest()[1]
        wanted = keys.select(manifest["key"]).distinct()
        touched = {r[0] for r in wanted.select(self.bucket(manifest)).distinct().collect()}  # the number of buckets at most
        return self.rows(manifest, touched).join(wanted, manifest["key"], "left_semi")

    def upsert(self, batch: DataFrame, order: str | None = None, epoch: tuple[str, int] | None = None) -> int:
        """Put the rows of batch in, each in place of that of its key; the version that holds them.

        Of rows of one key in a batch that of the greatest order stays, of equal ones, or without order, the greatest row;
        a null key is an error. epoch (name of the source, number) makes a batch that comes again do nothing. A run that ends
        before the switch leaves the old version as it was. Writers that touch the same bucket go one after the other; one
        that loses ATTEMPTS times gives up with an error.
        """
        version, manifest = self.manifest()
        if self.done(manifest, epoch):
            return version
        key, columns = manifest["key"], StructType.fromJson(json.loads(manifest["schema"])).names
        rest = F.struct(*(c for c in columns if c != key))
        last = F.max(F.struct(F.col(order).alias("order"), rest.alias("row")) if order else F.struct(rest.alias("row"))).alias("last")
        checked = F.coalesce(F.col(key), F.raise_error(F.lit("a row has no key")).cast(batch.schema[key].dataType))
        new = batch.withColumn(key, checked).groupBy(key).agg(last).select(key, *(F.col(f"last.row.{c}").alias(c) for c in columns if c != key))
        new = cut(new.select(*columns, self.bucket(manifest).alias(BUCKET)), "batch")
        touched = {r[0] for r in new.select(BUCKET).distinct().collect()}
        if not touched and epoch is None:
            return version
        merged = None
        for _ in range(ATTEMPTS):
            if merged is None or any(manifest["folders"].get(str(b)) != merged.get(b) for b in touched):
                merged = {b: manifest["folders"].get(str(b)) for b in touched}
                folder = f"v{version + 1}-{uuid.uuid4().hex}"
                kept = self.rows(manifest, touched).join(new.select(key), key, "left_anti")
                both = kept.select(*columns, self.bucket(manifest).alias(BUCKET)).unionByName(new)
                both.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{folder}")
            epochs = manifest["epochs"] | ({epoch[0]: epoch[1]} if epoch else {})
            after = manifest | {"folders": manifest["folders"] | {str(b): folder for b in touched}, "epochs": epochs}
            if self.log.put(version + 1, after):
                return version + 1
            version, manifest = self.manifest()
            if self.done(manifest, epoch):
                return version
        raise Conflict(f"{ATTEMPTS} other versions came first at {self.path}")

    @staticmethod
    def done(manifest: dict, epoch: tuple[str, int] | None) -> bool:
        return epoch is not None and manifest["epochs"].get(epoch[0], -1) >= epoch[1]

    def vacuum(self, kept: int = KEPT) -> list[str]:
        """Delete manifests but the newest, and folders that none of those names; those deleted. Not while another writer is at work."""
        numbers = self.log.numbers()
        used = {f for n in numbers[-kept:] for f in self.log.at(n)["folders"].values()}
        for n in numbers[:-kept]:
            self.log.forget(n)
        gone = [f for f in names(self.spark, f"{self.path}/data") if f not in used]
        for f in gone:
            delete(self.spark, f"{self.path}/data/{f}")
        return gone
