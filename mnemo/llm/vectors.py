"""What the operators on embedding tables share: which rows can be used, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(vector: str) -> Column:
    """Is the vector there, not empty, and without null, NaN or infinite entries?"""
    def bad(c: Column) -> Column:
        d = c.cast("double")
        return c.isNull() | F.isnan(d) | (F.abs(d) == float("inf"))

    return F.coalesce((F.size(F.col(vector)) > 0) & ~F.coalesce(F.exists(F.col(vector), bad), F.lit(True)), F.lit(False))


def dimension(rows: DataFrame, vector: str, weight: Column | None = None) -> int:
    """The length that most rows have (of equally frequent ones the longest); 0 for an empty table."""
    weight = F.lit(1) if weight is None else weight
    top = rows.groupBy(F.size(vector).alias("d")).agg(F.sum(weight).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).first()
    return top["d"] if top else 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column whose lists all have ``width`` entries, as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def lists(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as a list column; NaN entries become null."""
    n, width = rows.shape
    flat = np.ascontiguousarray(rows, dtype=np.float64).reshape(-1)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(flat, mask=np.isnan(flat)))
