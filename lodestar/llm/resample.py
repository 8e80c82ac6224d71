"""Importance resampling towards a target: hashed n-gram counts as stored CSR blocks, column sums, a product with the gains of the buckets."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 2, 20, 25, 7
#: Features that a block holds before it is closed; a longer text has a block of its own.
BLOCK = 50_000
#: Blocks of a row group of the stored matrix. A task decodes a row group at most at once, however large its file is.
GROUP_BLOCKS = 16
CSR = "block long, ids array<long>, n_words array<int>, starts array<int>, buckets array<int>, counts array<int>"
#: Bytes of a word, A-Z as a-z; all others part words.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def features(text: bytes, buckets: int, longest: int) -> tuple[int, np.ndarray]:
    """The number of words, and the bucket of each run of 1 to longest of them: CRC-32 of the words joined by a space."""
    words = text.translate(LETTERS).split()
    crc = zlib.crc32
    runs = [crc(w) for w in words]
    spaced = [b" " + w for w in words] if longest > 1 else []
    found, size = list(runs), len(words)
    for n in range(1, min(longest, size)):  # each run of n words and the next word
        runs = [crc(w, r) for w, r in zip(spaced[n:], runs[: size - n], strict=True)]
        found += runs
    return size, np.array(found, np.uint32).astype(np.int64) % buckets


def listed(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    return pa.array([pa.array(r, kind, from_pandas=False) for r in rows], pa.list_(kind))


def to_blocks(buckets: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, held, features_held = [], [], [], 0
        number = TaskContext.get().partitionId() << 32

        def block() -> pa.RecordBatch:
            """Rows of the matrix by their places; equal buckets of a row are one entry."""
            row = np.repeat(np.arange(len(ids)), [len(x) for x in held])
            entries, counts = np.unique(row * buckets + np.concatenate(held), return_counts=True)
            starts = np.searchsorted(entries, np.arange(len(ids) + 1) * buckets)
            columns = [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), *(listed([x], pa.int32()) for x in (np.array(sizes), starts, entries % buckets, counts))]
            return pa.RecordBatch.from_arrays(columns, ["block", "ids", "n_words", "starts", "buckets", "counts"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                size, found = features(text.as_py(), buckets, longest)
                if ids and features_held + len(found) > BLOCK:
                    yield block()
                    ids, sizes, held, features_held, number = [], [], [], 0, number + 1
                ids.append(doc_id.as_py())
                sizes.append(size)
                held.append(found)
                features_held += len(found)
        if ids:
            yield block()

    return run


def csr_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """The sparse matrix of documents by buckets, a row a block; documents of a block in the order of ids, starts having one more."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    return rows.mapInArrow(to_blocks(buckets, longest), CSR)


def stored(blocks: DataFrame) -> DataFrame:
    """The matrix, written to the shared folder once, in row groups of bounded size."""
    return cut(blocks, "csr-blocks", **{"parquet.block.row.count.limit": GROUP_BLOCKS})


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): each task sends on one row for each bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for at, n in zip(batch.column(0), batch.column(1), strict=True):
                total += np.bincount(at.values.to_numpy(), n.values.to_numpy(), buckets).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    sums = blocks.select("buckets", "counts").mapInArrow(run, "bucket int, n long")
    return sums.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """What a feature of each bucket adds, in thousandths of a nat. The sums have a row for each bucket at most."""
    s, t = ({r["bucket"]: r["n"] for r in sums.collect()} for sums in (source, target))
    all_s, all_t = sum(s.values()), sum(t.values())
    ratio = lambda b: float(t.get(b, 0) + 1) * (all_s + buckets) / (float(s.get(b, 0) + 1) * (all_t + buckets))
    return [math.floor(1000 * math.log(ratio(b))) for b in range(buckets)]


def weights(blocks: DataFrame, gain: list[int]) -> DataFrame:
    """(block, place, id, n_words, n_features, weight): the product of the matrix with the gains, over the features of each row."""
    sent = blocks.sparkSession.sparkContext.broadcast(np.array(gain, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, ids, sizes, starts, at, n in zip(*batch.columns, strict=True):
                starts, n = starts.values.to_numpy(), n.values.to_numpy().astype(np.int64)
                # of the running sums the differences at a row's ends: rows without entries have none
                total, size = (np.diff(np.concatenate([[0], np.cumsum(x)])[starts]) for x in (n * sent.value[at.values.to_numpy()], n))
                mean = total // np.maximum(size, 1)
                columns = [np.full(len(size), number.as_py()), np.arange(len(size)), ids.values, sizes.values.cast(pa.int64()), size, mean]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["block", "place", "id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(run, "block long, place long, id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """A Gumbel number in thousandths by the id's hash, so that a draw can be repeated. A null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def draw(scored: DataFrame, n: int) -> DataFrame:
    """scored (score, id, block, place, ...) with rank, from 1, for the n of the highest scores, ties by id, null for the others.

    Rows are sorted over all tasks; a row's rank is its place among those of its task after the rows of all tasks before.
    """
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), "block", "place"]
    at = cut(scored.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), "drawn")
    sizes = {r["task"]: r["n"] for r in at.groupBy(F.shiftright("at", 33).alias("task")).agg(F.count("*").alias("n")).collect()}
    before, rows = 0, []
    for task in sorted(sizes):
        rows.append((task, before))
        before += sizes[task]
    spark = scored.sparkSession
    at = at.join(F.broadcast(spark.createDataFrame(rows, "task long, before long")), F.shiftright("at", 33) == F.col("task"))
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return at.select(*scored.columns, F.when(rank <= n, rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(id_col, n_features, weight, score, rank) for each row of docs: of those with least_words words percent of a hundred are drawn.

    Words are runs of letters and digits of ASCII and of all other characters, A-Z in lower case. The matrix is written to
    the shared folder once and read for both distributions and weights; what the driver gathers has a row a bucket or task.

    A null or empty text has no features, weight 0 and no rank; texts of any length are counted whole; repeated rows, of
    null ids too, each count and have a row, ranked next to each other. Other columns of docs aren't looked at, and may have
    any name. Without documents the result is empty; with an empty target all buckets are smoothed alike.
    """
    blocks = stored(csr_blocks(docs, id_col, text_col, buckets, longest))
    wanted = csr_blocks(target.select(F.lit(0).alias("id"), target_text), "id", target_text, buckets, longest)
    gain = gains(column_sums(blocks, buckets), column_sums(wanted, buckets), buckets)
    scored = cut(weights(blocks, gain).withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "weights")
    enough = F.col("n_words") >= least_words
    n = scored.where(enough).count() * percent // 100
    out = draw(scored.where(enough), n).unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
