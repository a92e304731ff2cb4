"""Vectors of a table as numbers in tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def sound_vectors(table: DataFrame, nonzero: bool = False) -> DataFrame:
    """``table(vec_id, embedding, …)`` → its rows with an id and a vector that can be compared.

    Rows with a null id or vector or a null or non-finite component are left out, and with ``nonzero``
    also zero vectors. Vectors of different lengths have no distance: those of the most common length
    (ties: the shorter) stay, empty ones never do.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is larger
    rows = table.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    if nonzero:
        rows = rows.where(F.exists("embedding", lambda x: x != 0))
    sizes = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size")
    common = sizes.first()
    return rows.where(F.size("embedding") == (common["size"] if common else 0))


def one_per_id(rows: DataFrame, order: Column) -> DataFrame:
    """Of rows that share a ``vec_id`` the least by ``order``; nothing is shuffled where ids are unique."""
    again = rows.groupBy("vec_id").count().where("count > 1").select("vec_id")
    if again.isEmpty():
        return rows
    least = rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min_by(F.struct(*rows.columns), order).alias("row"))
    return rows.join(again, "vec_id", "left_anti").unionByName(least.select("row.*"))


def matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    """A list column without nulls, all of one length, as a matrix."""
    if not len(column):
        return np.zeros((0, 0), kind)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def packed(table: np.ndarray) -> pa.Array:
    """Each row of a matrix as one binary value."""
    data, width = np.ascontiguousarray(table).tobytes(), table.shape[1] * table.itemsize
    ends = np.arange(len(table) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(table), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def unpacked(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """The matrix that :func:`packed` was given."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1) if values else np.zeros((0, 0), kind)
