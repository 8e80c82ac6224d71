"""Vectors as float arrays, arithmetic in doubles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def matrix(column: pa.Array, dims: int | None = None) -> np.ndarray:
    """Rows of a column of arrays; one of another width, or with a null element, is an error."""
    widths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(widths) and ((widths != (dims or widths[0])).any() or np.isnan(flat).any()):
        raise ValueError(f"vectors must have {dims or widths[0]} numbers")
    return flat.reshape(len(widths), -1)
