"""Vectors of whole numbers: which rows take part, and their components scaled and rounded down."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256
LARGEST = 1 << 24  # of a scaled component, so that sums of squares and products stay exact


def usable(vector: str) -> Column:
    """Whether a vector is there, is not empty, and all its components are finite numbers."""
    v = F.col(vector)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & whole, F.lit(False))


def dimension(rows: DataFrame, id_col: str, vector: str) -> int:
    """Components of the usable vector of the smallest id; 0 where there is none."""
    least = rows.agg(F.min(F.struct(F.col(id_col).isNull(), F.col(id_col), F.size(vector).alias("d")))["d"].alias("d")).first()
    return least.d or 0


def kept(rows: DataFrame, id_col: str, vector: str) -> tuple[DataFrame, int]:
    """The usable rows whose vectors have as many components as that of the smallest id, and that number."""
    rows = rows.where(usable(vector))
    d = dimension(rows, id_col, vector)
    return rows.where(F.size(vector) == d), d


def scaled(column: pa.Array, d: int) -> np.ndarray:
    """rows x ``d`` of floor(SCALE * x), int64. Beyond LARGEST is an error."""
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    out = np.floor(flat * SCALE)
    if out.size and np.abs(out).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST // SCALE} cannot be scaled exactly")
    return out.astype(np.int64)
