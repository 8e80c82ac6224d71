"""Text encoders: a function from texts to vectors, handed in by the caller and run on Arrow batches in the workers."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What stands before a query, not before a passage, and how far a norm may be from 1.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
NORM_ERROR = 1e-3
#: Devices in the order in which they are taken.
FASTEST = ("mps", "cuda")
#: Texts that the encoder gets at once.
BATCH = 128

Encoder = Callable[[list[str]], np.ndarray]


def resolve(preferred: str | None, known: Iterable[str], variable: str, default: str, env: Mapping[str, str] | None = None) -> str:
    """The backend asked for, else that of the environment, else the default; one that isn't known is an error."""
    known, env = list(known), os.environ if env is None else env
    name = preferred or env.get(variable) or default
    if name not in known:
        raise ValueError(f"no such encoder backend: {name}; there are {', '.join(known)}")
    return name


def device(preferred: str | None, available: Callable[[str], bool]) -> str:
    """The device asked for, else the first of FASTEST that there is, else the CPU; available says of a name whether there is one."""
    return preferred or next((d for d in FASTEST if available(d)), "cpu")


def require_unit_norm(vectors: np.ndarray, what: str) -> None:
    """An error if a vector is not of length 1, as cosine ranks would be ranks of length then."""
    if len(vectors):
        norms = np.linalg.norm(np.asarray(vectors, np.float64), axis=1)
        worst = norms[np.abs(norms - 1).argmax()]
        if not abs(worst - 1) <= NORM_ERROR:
            raise ValueError(f"{what}: a vector has the norm {worst:.6f} in place of 1")


def require_contract(encode: Encoder, dims: int, what: str = "encoder") -> None:
    """One probe: the width of the index and unit norm, or an error."""
    probe = np.asarray(encode([QUERY_PREFIX + "total assets"]))
    if probe.shape != (1, dims):
        raise ValueError(f"{what}: vectors of shape {probe.shape} in place of (1, {dims})")
    require_unit_norm(probe, what)


def by_length(encode: Encoder, texts: list[str], dims: int, batch: int = BATCH) -> np.ndarray:
    """The texts' vectors in their order, encoded in batches of like length, the longest first, so that little is padded."""
    out = np.empty((len(texts), dims), np.float32)
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    for at in range(0, len(order), batch):
        part = order[at : at + batch]
        out[part] = encode([texts[i] for i in part])
    return out


def encoded(rows: DataFrame, make: Callable[[], Encoder], dims: int, prefix: str = "", id_col: str = "id", text_col: str = "text", batch: int = BATCH) -> DataFrame:
    """rows -> (id, embedding): make gives the encoder, once a task, where its contract is checked too.

    A null text counts as empty; a null id stays null; no rows give none. A vector that isn't of
    length 1 is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for given in batches:
            if not given.num_rows:
                continue
            if encode is None:
                encode = make()
                require_contract(encode, dims)
            vectors = by_length(encode, [prefix + t for t in given.column(1).to_pylist()], dims, batch)
            require_unit_norm(vectors, "encoder")
            flat = pa.array(vectors.reshape(-1), pa.float32())
            yield pa.RecordBatch.from_arrays([given.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * dims), flat)], ["id", "embedding"])

    source = rows.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return source.mapInArrow(run, "id long, embedding array<float>")


def passages(rows: DataFrame, make: Callable[[], Encoder], dims: int, id_col: str = "chunk_id", **options) -> DataFrame:
    """Vectors of texts to find: nothing stands before them."""
    return encoded(rows, make, dims, "", id_col, **options)


def queries(rows: DataFrame, make: Callable[[], Encoder], dims: int, id_col: str = "query_id", **options) -> DataFrame:
    """Vectors of texts to search with: QUERY_PREFIX stands before them."""
    return encoded(rows, make, dims, QUERY_PREFIX, id_col, **options)
