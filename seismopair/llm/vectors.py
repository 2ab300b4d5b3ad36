"""What the vector operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def usable(vector: str) -> Column:
    """The vector is there, of one component at least, all of them finite, and not zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def packing(df: DataFrame, vector: str) -> str:
    """How components travel: in four bytes where the column has no more."""
    return "<f4" if isinstance(df.schema[vector].dataType.elementType, T.FloatType) else "<f8"


def dimension(df: DataFrame, key: str, vector: str) -> int:
    """Components of the usable vector of smallest key; others of another length take no part."""
    row = df.where(usable(vector) & F.col(key).isNotNull()).agg(F.min_by(F.size(vector), F.col(key))).first()
    return row[0] or 0


def prepared(df: DataFrame, key: str, vector: str, size: int, *more: str) -> DataFrame:
    """id, v (array of double) and further columns, of the rows that take part."""
    return df.where(usable(vector) & F.col(key).isNotNull() & (F.size(vector) == size)).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), *more)


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), size)


def sample(rows: DataFrame, most: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of the rows of smallest id hash, `most` at most."""
    table = rows.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(most).select("id", "v").toArrow()
    if not table.num_rows:
        return np.zeros(0, np.int64), np.zeros((0, size))
    return table["id"].to_numpy(), matrix(table["v"].combine_chunks(), size)
