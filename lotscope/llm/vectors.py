"""Vectors in Arrow columns as numpy rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def rows(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: ids and vectors in double precision, of rows with an id and a vector that is not null, not zero and all finite numbers."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    n = len(vectors)
    if not n:
        return {}
    sizes = np.array(pa.compute.fill_null(pa.compute.list_value_length(vectors), 0).to_numpy(zero_copy_only=False), np.int64)
    flat = pa.compute.list_flatten(vectors).cast(pa.float64())
    values = np.array(flat.to_numpy(zero_copy_only=False), np.float64)  # nulls become nan
    starts = np.cumsum(sizes) - sizes
    known = np.array(pa.compute.is_valid(ids).to_numpy(zero_copy_only=False)) & (sizes > 0)
    keys = np.array(pa.compute.fill_null(ids, 0).cast(pa.int64()).to_numpy(zero_copy_only=False))
    out = {}
    for d in np.unique(sizes[known]):
        at = np.flatnonzero(known & (sizes == d))
        x = values[starts[at][:, None] + np.arange(d)]
        with np.errstate(over="ignore"):
            ok = np.isfinite(x).all(axis=1) & (np.abs(x).max(axis=1) > 0)
        if ok.any():
            out[int(d)] = keys[at[ok]], x[ok]
    return out


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, without overflow or underflow on the way."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the row of b at the same place (b may have one more axis in between), in double precision."""
    eq = "ij,ij->i" if b.ndim == 2 else "ij,ikj->ik"
    return np.einsum(eq, a, b)
