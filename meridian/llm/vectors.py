"""Reading float vectors into matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array, dim: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, values): rows that hold `dim` finite components (any equal number if None), and their components as double."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    good = np.asarray(column.is_valid())
    sizes = np.diff(np.asarray(column.offsets))
    flat = column.flatten().cast(pa.float64())
    missing = np.asarray(flat.is_null())
    flat = np.asarray(flat.fill_null(np.nan)) if flat.null_count else np.asarray(flat)
    sizes = np.where(good, sizes, 0)
    row = np.repeat(np.arange(len(sizes)), sizes)
    bad = np.bincount(row[missing | ~np.isfinite(flat)], minlength=len(sizes)) > 0
    good &= ~bad & (sizes > 0)
    if dim is None:
        dim = int(sizes[good][0]) if good.any() else 0
    good &= sizes == dim
    rows = np.flatnonzero(good)
    begin = np.concatenate(([0], np.cumsum(sizes)))[rows]
    return rows, flat[begin[:, None] + np.arange(dim)] if len(rows) else np.zeros((0, dim))
