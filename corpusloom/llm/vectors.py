"""What embedding operators share: which vectors take part, and their Arrow form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def takes_part(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    inf = F.lit(float("inf"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def dimension(vectors: DataFrame, column: str) -> int:
    """The longest vector; shorter ones count as padded with zeros."""
    return vectors.agg(F.max(F.size(column))).first()[0] or 0


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """(rows, dim) float64 from an Arrow list column without nulls."""
    sizes = np.asarray(lists.value_lengths())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows over their length, safe for very large and very small components."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
