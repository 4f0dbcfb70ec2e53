"""Vectors as integer rows, shared by the operators on integer components."""

from __future__ import annotations

import math

import numpy as np


def whole_vectors(lists, dims: int | None = None) -> tuple[np.ndarray, list]:
    """Of an Arrow array of lists of doubles: (rows in all, [(dims, rows, matrix)] of vectors without null or non-finite
    components), all lengths or the given one."""
    import pyarrow.compute as pc

    lengths = pc.list_value_length(lists).fill_null(-1).to_numpy(zero_copy_only=False)
    found = []
    for d in np.unique(lengths).tolist() if dims is None else [dims]:
        if d < 0:
            continue
        rows = np.flatnonzero(lengths == d)
        values = lists.take(rows).flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null: NaN
        matrix = values.reshape(len(rows), d)
        good = np.isfinite(matrix).all(axis=1)
        found.append((d, rows[good], matrix[good]))
    return lengths, found


def floored(matrix: np.ndarray, scale: int, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have all of floor(scale * x) within the bound, these as integers)."""
    with np.errstate(over="ignore"):
        scaled = np.floor(matrix * float(scale))
    good = (np.abs(scaled) <= bound).all(axis=1)
    return good, scaled[good].astype(np.int64)


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integer matrices whose products fit a long: in doubles where these are exact, else in integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if a.shape[1] * int(np.abs(a).max()) * int(np.abs(b).max()) < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def component_bound(dims: int, bits: int) -> int:
    """Components up to this keep sums of ``dims`` products of two of them within 2^bits."""
    return math.isqrt((1 << bits) // max(1, dims))
