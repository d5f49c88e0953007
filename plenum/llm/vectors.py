"""Vectors that count: no null, zero or non-finite ones, and equal vectors together."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid(vectors: DataFrame, *others: str) -> DataFrame:
    """vec_id, v (array of double) of the vectors that count; others: columns kept."""
    v = F.col("embedding").cast("array<double>")
    fine = "v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)"
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), *others).where("vec_id IS NOT NULL").where(fine)


def matrix(column) -> np.ndarray:
    """Rows of a list column as one array of doubles; all of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by the largest component first, so that nothing overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))
