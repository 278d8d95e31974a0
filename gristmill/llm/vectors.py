"""Vector columns inside tasks: lists as matrices, and which rows take part."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(v: Column, scale: float, limit: float) -> Column:
    """Whether a vector is there and all its components, scaled, are numbers under a limit."""
    within = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * scale) < limit))
    return F.coalesce(v.isNotNull() & within, F.lit(False))


def by_length(batch: pa.RecordBatch, name: str, rows: int = 2000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(length, places, matrix)`` of the vectors of each length, in doubles, at most ``rows`` at a time; vectors hold no nulls."""
    lists = batch.column(name)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts, size = offsets[:-1] - offsets[0], np.diff(offsets)
    for dim in np.unique(size).tolist():
        at = np.flatnonzero(size == dim)
        for k in range(0, len(at), rows):
            part = at[k : k + rows]
            yield dim, part, flat[starts[part][:, None] + np.arange(dim)].reshape(len(part), dim)
