"""Approximate k-NN over an inverted file: vectors are stored by the cell of their nearest centroid, with a code of sign bits.

A search reads the codes of the cells nearest to each query, and compares the query with the vectors whose codes are closest.
Knobs are ef, the vectors that get an exact score, and reach, how many times as many codes are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from lodestar.functions.storage import cut, exists
from lodestar.functions.vectors import matrix
from lodestar.operators.measurement import ann_recall
from lodestar.operators.retrieval import matches, top

#: The fit sees some SAMPLE vectors, by hash of their ids; every vector is then stored. Rounds of k-means, and slices of the sample.
SAMPLE, ROUNDS, SLICES = 100_000, 10, 8
#: Vectors, and queries, that one task of a search holds of a cell; larger cells are dealt out.
PART_ROWS, PART_QUERIES = 50_000, 2_000
#: Pairs of a query and a cell that a task ranks at a time.
PROBES = 100_000
#: 64-bit words of a code, and codes read for each vector scored.
WORDS, REACH = 4, 8


def nearest_cell(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmax(vectors @ centroids.T, axis=1)


def codes(vectors: np.ndarray) -> np.ndarray:
    """The signs of projections on WORDS times 64 random directions, as words of bits: codes of near vectors differ in few."""
    planes = np.random.default_rng(64).standard_normal((vectors.shape[1], 64 * WORDS))
    return np.packbits(vectors @ planes > 0, axis=1).view(np.int64)


def fit(vectors: DataFrame, cells: int, sample: int = SAMPLE, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Spherical k-means of vectors (id, embedding): centroids of unit length. Tasks send the driver sums by cell, SLICES times cells rows a round."""
    spark, order = vectors.sparkSession, F.xxhash64("id", F.lit(seed))
    n, slots = vectors.count(), 1 << 30
    taken = vectors.where(F.pmod(order, F.lit(slots)) < int(min(1.0, 1.2 * sample / max(n, 1)) * slots)).select("id", "embedding")
    taken = cut(taken.repartition(SLICES, "id"), "sample")
    first = taken.select("embedding", order.alias("o")).orderBy("o").limit(cells).collect()
    if not first:
        raise ValueError("no vectors to fit cells to")
    centroids = np.array([r["embedding"] for r in first], np.float64)
    centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    dims = centroids.shape[1]

    def sums(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, size = np.zeros_like(held.value), np.zeros(len(held.value), np.int64)
            for batch in batches:
                rows = matrix(batch.column(0), dims)
                at = nearest_cell(rows, held.value)
                np.add.at(total, at, rows)
                size += np.bincount(at, minlength=len(size))
            used = np.flatnonzero(size)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used].tolist(), pa.list_(pa.float64()))], ["cell", "total"])

        return run

    for _ in range(rounds):
        held = spark.sparkContext.broadcast(centroids)
        total = np.zeros_like(centroids)
        for r in taken.select("embedding").mapInArrow(sums(held), "cell int, total array<double>").collect():
            total[r["cell"]] += r["total"]
        held.destroy()
        length = np.linalg.norm(total, axis=1, keepdims=True)
        moved = np.where(length > 1e-12, total / np.maximum(length, 1e-12), centroids)  # a cell without vectors stays where it was
        if np.allclose(moved, centroids, atol=1e-9):
            break
        centroids = moved
    return centroids


@dataclass(frozen=True)
class Cells:
    """A stored index: its vectors by cell, and (cell, centroid, n)."""

    spark: SparkSession
    path: str

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    @property
    def centroids(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/centroids")


def build(vectors: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE, seed: int = 7) -> Cells:
    """Store vectors (id, embedding, …) below path by their cells, some square root of their number without cells given.

    Vectors must be of one width and free of nulls. Rows without an embedding aren't stored. A cell of many vectors is several files.
    The centroids are written last: an index that lacks them is no index.
    """
    spark = vectors.sparkSession
    vectors = vectors.where("embedding is not null")
    centroids = fit(vectors, cells or max(1, math.isqrt(vectors.count())), sample, seed=seed)
    held, names = spark.sparkContext.broadcast(centroids), vectors.columns

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = matrix(batch.column(names.index("embedding")), held.value.shape[1])
                added = [pa.array(list(codes(rows)), pa.list_(pa.int64())), pa.array(nearest_cell(rows, held.value), pa.int32())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*names, "code", "cell"])

    schema = StructType([*vectors.schema.fields, StructField("code", ArrayType(LongType())), StructField("cell", IntegerType())])
    placed = vectors.mapInArrow(assign, schema).hint("rebalance", "cell").sortWithinPartitions("cell")
    placed.write.partitionBy("cell").mode("error").parquet(f"{path}/vectors")
    sizes = {r["cell"]: r["n"] for r in spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(F.count("*").alias("n")).collect()}
    rows = [(i, c.tolist(), sizes.get(i, 0)) for i, c in enumerate(centroids)]
    spark.createDataFrame(rows, "cell int, centroid array<double>, n long").coalesce(1).write.parquet(f"{path}/centroids")
    return Cells(spark, path)


def opened(spark: SparkSession, path: str) -> Cells:
    if not exists(spark, f"{path}/centroids/_SUCCESS"):
        raise ValueError(f"no index at {path}")
    return Cells(spark, path)


def probes(queries: DataFrame, index: Cells, ef: int, filters: Mapping[str, object] | None = None) -> DataFrame:
    """(query_id, embedding, cell, n): of the cells nearest to each query as many as hold ef vectors that meet the filters, n of them in the cell."""
    stored = sorted((r["cell"], r["centroid"], r["n"]) for r in index.centroids.collect())  # a row a cell
    sizes = np.array([n for _, _, n in stored], np.int64)
    if filters:
        found = {r["cell"]: r["n"] for r in index.vectors.where(matches(filters)).groupBy("cell").agg(F.count("*").alias("n")).collect()}
        sizes = np.array([found.get(c, 0) for c, _, _ in stored], np.int64)
    held = index.spark.sparkContext.broadcast((np.array([c for _, c, _ in stored]), sizes))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, n = held.value
        used = np.flatnonzero(n)
        for batch in batches:
            if not batch.num_rows or not len(used):
                continue
            # a query may probe every cell, so queries are taken by as many as have PROBES pairs with cells
            step = max(1, PROBES // len(used))
            for part in (batch.slice(at, step) for at in range(0, batch.num_rows, step)):
                order = used[np.argsort(-(matrix(part.column(1), centroids.shape[1]) @ centroids[used].T), axis=1, kind="stable")]
                before = np.cumsum(n[order], axis=1) - n[order]
                query, place = np.nonzero(before < ef)
                cell = order[query, place]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(query)), part.column(1).take(pa.array(query)), pa.array(cell, pa.int32()), pa.array(n[cell])], ["query_id", "embedding", "cell", "n"])

    asked = queries.where("embedding is not null").select(F.col("id").cast("long"), F.col("embedding").cast("array<float>"))
    return asked.mapInArrow(choose, "query_id long, embedding array<float>, cell int, n long")


def distances(vectors: pa.Table, queries: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Of each query the bits in which its code differs from those of the vectors."""
    held = matrix_of_words(vectors)
    asks = matrix(queries.column("embedding").combine_chunks())
    for q, code in zip(queries.column("query_id").to_numpy(), codes(asks), strict=True):
        yield q, np.bitwise_count((held ^ code).view(np.uint64)).sum(axis=1, dtype=np.int64)


def matrix_of_words(vectors: pa.Table) -> np.ndarray:
    return vectors.column("code").combine_chunks().flatten().to_numpy().reshape(vectors.num_rows, WORDS)


def bits_read(vectors: pa.Table, queries: pa.Table) -> pa.Table:
    """(query_id, bits, n): how many codes are so many bits away."""
    out = [[np.zeros(0, np.int64)] for _ in range(3)]
    if vectors.num_rows and queries.num_rows:
        for q, far in distances(vectors, queries):
            n = np.bincount(far)
            used = np.flatnonzero(n)
            for column, values in zip(out, (np.full(len(used), q), used, n[used]), strict=True):
                column.append(values)
    return pa.table([np.concatenate(c) for c in out], ["query_id", "bits", "n"])


def compared(asked: DataFrame, index: Cells, ef: int, filters: Mapping[str, object] | None) -> tuple[DataFrame, Callable[[DataFrame, list[str]], tuple]]:
    """(query_id, most, scored): the bits within which the ef closest codes are, and how many are; and the sides of a search, dealt by cell."""
    sizes = asked.groupBy("cell").agg(F.ceil(F.first("n") / PART_ROWS).cast("int").alias("parts"), F.ceil(F.count("*") / PART_QUERIES).cast("int").alias("sides"))
    sizes = F.broadcast(sizes)  # a row a cell
    part, side = (F.pmod(F.xxhash64(c), F.col(n)).cast("int") for c, n in (("id", "parts"), ("query_id", "sides")))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["cell", "part", "side"]

    def dealt(asks: DataFrame, columns: list[str]):
        rows = index.vectors.where(matches(filters)).join(sizes, "cell").select("cell", part.alias("part"), spread("sides").alias("side"), *columns)
        asks = asks.join(sizes, "cell").select("cell", spread("parts").alias("part"), side.alias("side"), *(c for c in asks.columns if c != "cell"))
        return rows.groupBy(*keys).cogroup(asks.groupBy(*keys))

    counts = dealt(asked.drop("n"), ["code"]).applyInArrow(bits_read, "query_id long, bits long, n long").groupBy("query_id", "bits").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("query_id").orderBy("bits").rowsBetween(Window.unboundedPreceding, -1))
    within = counts.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < ef)  # a row for each number of bits at most
    return within.groupBy("query_id").agg(F.max("bits").alias("most"), F.sum("n").alias("scored")), dealt


def nearest_in_cells(queries: DataFrame, index: Cells, k: int, ef: int | None = None, filters: Mapping[str, object] | None = None, exclude_self: bool = False, digits: int = 6, reach: int = REACH) -> DataFrame:
    """(query_id, chunk_id, score, rank) like retrieval.nearest, of the vectors that the probes and codes leave.

    ef None is k; less than k is an error, as fewer than k would come back. Filters count for the cells to probe, so k rows
    that meet them come back wherever there are as many. An ef of all rows gives the exact result.
    """
    if ef is not None and ef < k:
        raise ValueError(f"ef of {ef} is below k of {k}")
    ef = (ef or k) + exclude_self
    asked = cut(probes(queries, index, reach * ef, filters), "probes")
    limits, dealt = compared(asked, index, ef, filters)

    def score(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if vectors.num_rows and queries.num_rows:
            own, cols = vectors.column("id").to_numpy(), matrix(vectors.column("embedding").combine_chunks())
            asks = matrix(queries.column("embedding").combine_chunks(), cols.shape[1])
            for (q, far), ask, most in zip(distances(vectors, queries), asks, queries.column("most").to_numpy(), strict=True):
                at = np.flatnonzero((far <= most) & (own != q) if exclude_self else far <= most)
                s = np.round(cols[at] @ ask, digits)
                if len(at) > k:  # all that tie with the k-th, then ids decide
                    keep = s >= np.partition(s, -k)[-k]
                    at, s = at[keep], s[keep]
                order = np.lexsort((own[at], -s))[:k]
                for column, values in zip(out, (np.full(len(order), q), own[at][order], s[order]), strict=True):
                    column.append(values)
        return pa.table([np.concatenate(c) for c in out], ["query_id", "chunk_id", "score"])

    vector = [F.col("id").cast("long").alias("id"), "code", F.col("embedding").cast("array<float>").alias("embedding")]
    found = dealt(asked.join(limits.select("query_id", "most"), "query_id").drop("n"), vector)
    return top(found.applyInArrow(score, "query_id long, chunk_id long, score double"), k)


def curve(queries: DataFrame, index: Cells, exact: DataFrame, k: int, settings: list[int], reach: int = REACH) -> DataFrame:
    """(ef, recall, recall_min, read, scored): recall against the exact lists, and the shares of all vectors whose codes a query reads and that it is scored with."""
    n = index.centroids.agg(F.sum("n")).first()[0]

    def point(ef: int) -> DataFrame:
        found = ann_recall(exact, nearest_in_cells(queries, index, k, ef, reach=reach), k)
        recall = found.agg(F.round(F.avg("recall"), 6).alias("recall"), F.round(F.min("recall"), 6).alias("recall_min"))
        asked = cut(probes(queries, index, reach * ef), "probes")
        read = asked.groupBy("query_id").agg(F.sum("n").alias("n")).agg(F.round(F.avg("n") / n, 6).alias("read"))
        scored = compared(asked, index, ef, None)[0].agg(F.round(F.avg("scored") / n, 6).alias("scored"))
        return recall.crossJoin(F.broadcast(read)).crossJoin(F.broadcast(scored)).select(F.lit(ef).alias("ef"), "*")  # one row each

    return reduce(DataFrame.unionByName, map(point, settings))
