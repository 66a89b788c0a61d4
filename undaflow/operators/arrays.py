"""Numpy kernels on array columns, batch by batch and without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType


def matrix(column) -> np.ndarray:
    """A column of equally long arrays as rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def lists(m: np.ndarray) -> pa.Array:
    n, d = m.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d or 1, dtype=np.int32)[: n + 1]), pa.array(np.ascontiguousarray(m, dtype=np.float64).ravel()))


def apply(df: DataFrame, columns: list[str], fn: Callable[..., tuple[np.ndarray, ...]], out: list[str]) -> DataFrame:
    """``df`` without ``columns``, with what ``fn`` gives for their matrices as array columns ``out``. The arrays of one
    column are of one length."""
    keep = [f for f in df.schema.fields if f.name not in columns and f.name not in out]

    def run(batches):
        for b in batches:
            got = fn(*(matrix(b.column(c)) for c in columns)) if b.num_rows else [np.empty((0, 0))] * len(out)
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in keep), *map(lists, got)], [*(f.name for f in keep), *out])

    schema = StructType([*keep, *(StructField(c, ArrayType(DoubleType())) for c in out)])
    return df.mapInArrow(run, schema)


def project(df: DataFrame, v: str, weights: np.ndarray, out: str | None = None) -> DataFrame:
    """``weights @ v`` for every row."""
    return apply(df, [v], lambda x: (x @ weights.T,), [out or v])
