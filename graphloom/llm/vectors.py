"""Vectors of a table as matrices of whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def floored(column: pa.Array, factor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the rows whose vector is neither null nor holds a null or non-finite component; floor(factor * x) of
    all their components, x as a double, one after another; how many each row has."""
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    x = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null component is not a number
    there = np.flatnonzero(size >= 0)
    of = np.repeat(there, size[there])
    good = size >= 0
    good[of[~np.isfinite(x)]] = False
    with np.errstate(over="ignore"):
        return np.flatnonzero(good), np.floor(x[good[of]] * factor), size[good]


def lists(flat: np.ndarray, size: np.ndarray) -> pa.ListArray:
    """The rows' components as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(flat))


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """A list column without nulls as a matrix: shorter rows end in zeros, width (the longest row's size if not given) columns."""
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = int(size.max(initial=0)) if width is None else width
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), flat.dtype)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out
