"""Arrow columns of vectors as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrix(column: pa.Array | pa.ChunkedArray, width: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The vectors in double precision, and which rows have one (neither null nor empty).

    Shorter vectors are filled up with zeros to the longest, or to ``width`` if that is more; rows without one are zeros.
    """
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(size), max(width, int(size.max()) if len(size) else 0)))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out, size > 0
