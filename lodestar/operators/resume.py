"""Taking up a run again: rows whose id is stored already go where they are read, by a Bloom filter of the stored ids, and no text is moved."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.storage import small

#: Bits for each id, so that one in some 120 unknown ids looks known; hashes of an id; and the bits of a filter at most, 32 MB. More ids
#: fill it more, and more of the unknown are then told apart by the join.
BITS, HASHES, MOST_BITS = 10, 7, 1 << 28
#: Bytes of a filter that are put together as one row.
SLICE = 1 << 16


def places(h: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each hash, a row a hash: steps of one half of it from the other."""
    h = h.view(np.uint64)
    first, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return (first + np.arange(HASHES, dtype=np.uint64)[:, None] * step) % np.uint64(bits)


@dataclass(frozen=True)
class Bloom:
    """A filter of ids: those it was made of are all in it, of others a few."""

    bits: int
    held: Broadcast

    def has(self, key: str | Column) -> Column:
        """Whether an id may be stored. A null one isn't."""
        bits, held = self.bits, self.held

        @F.pandas_udf("boolean")
        def known(h: pd.Series) -> pd.Series:
            at = places(h.to_numpy(np.int64), bits)
            return pd.Series((held.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(axis=0))

        key = F.col(key) if isinstance(key, str) else key
        return key.isNotNull() & known(F.xxhash64(key))


def bloom(known: DataFrame, key: str) -> Bloom:
    """The filter of a column. Tasks send slices of their bits; each slice is put together by itself, and the driver gets MOST_BITS at most."""
    ids = known.where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("h"))
    bits = int(min(MOST_BITS, max(64, -(-BITS * ids.count() // 8) * 8)))

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(-(-bits // 8), np.uint8)
        for batch in batches:
            at = places(batch.column(0).to_numpy(), bits).ravel()
            np.bitwise_or.at(found, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        parts = [(i, found[i * SLICE : (i + 1) * SLICE]) for i in range(-(-len(found) // SLICE))]
        parts = [(i, p.tobytes()) for i, p in parts if p.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], ["slice", "part"])

    def joined(part: pa.Table) -> pa.Table:
        whole = np.bitwise_or.reduce([np.frombuffer(p.as_py(), np.uint8) for p in part.column("part")])
        return pa.table({"slice": part.column("slice")[:1], "part": pa.array([whole.tobytes()], pa.binary())})

    out = np.zeros(-(-bits // 8), np.uint8)
    for r in ids.mapInArrow(set_bits, "slice int, part binary").groupBy("slice").applyInArrow(joined, "slice int, part binary").collect():
        part = np.frombuffer(bytes(r["part"]), np.uint8)
        out[r["slice"] * SLICE : r["slice"] * SLICE + len(part)] = part
    return Bloom(bits, known.sparkSession.sparkContext.broadcast(out))


def new_rows(rows: DataFrame, known: DataFrame, key: str, filter: Bloom | None = None) -> DataFrame:
    """The rows whose id known (key) lacks, as an anti join gives them; rows of a null id are new.

    Rows that the filter lacks are new at once. The ids of the others, without their rows, are joined to the stored ones; the
    few that only look stored then pick their rows. filter is that of an earlier call over the same ids.
    """
    filter = filter or bloom(known, key)
    looks = filter.has(key)
    taken = rows.where(looks).select(key).distinct().join(known.select(key).distinct(), key, "left_anti")
    found = rows.where(~looks).unionByName(rows.where(looks).join(small(taken), key, "left_semi").select(*rows.columns))
    return found
