"""Vector columns as padded matrices, shared by the vector searches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str) -> Column:
    """True for vectors that are not null and hold finite components only."""
    x = F.col(column)
    return x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def dimension(df: DataFrame, column: str) -> int:
    """The longest vector's length; shorter ones count as padded with zeros."""
    return df.agg(F.max(F.size(column)).alias("n")).first()["n"] or 0


def matrix(rows: list | np.ndarray, dim: int) -> np.ndarray:
    """Rows as a (n, dim) matrix in double precision."""
    out = np.zeros((len(rows), dim))
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def list_matrix(column, dim: int) -> np.ndarray:
    """An Arrow list column as a (n, dim) matrix in double precision."""
    lengths = np.diff(np.asarray(column.offsets))
    values = np.asarray(column.flatten(), dtype=np.float64)
    if len(lengths) and (lengths == dim).all():
        return values.reshape(-1, dim)
    out = np.zeros((len(lengths), dim))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.cumsum(lengths)
    out[rows, np.arange(len(values)) - np.repeat(ends - lengths, lengths)] = values
    return out
