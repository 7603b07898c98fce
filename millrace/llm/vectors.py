"""What the vector operators share: which vectors take part, and arrays from Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(embedding: Column) -> Column:
    """True for vectors that hold only finite components, at least one of them not 0; false for null."""
    whole = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(whole & F.exists(embedding, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an Arrow list column, all of one width, as a float64 matrix."""
    flat = column.flatten() if hasattr(column, "flatten") else column
    return np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, width)
