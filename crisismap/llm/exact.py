"""Exact integer inner products of vectors whose components are whole numbers in doubles."""

from __future__ import annotations

import numpy as np

LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


def products(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """int64 inner products of every row of the one with every row of the other matrix, exact.

    Every partial sum is at most length * max * max, so matrices of doubles do
    while that is below 2^53 and those of 64-bit integers below 2^63; beyond, Python's integers
    add up, and what no 64-bit integer can hold becomes the nearest one.
    """
    if not rows.size or not columns.size:
        return np.zeros((len(rows), len(columns)), np.int64)
    bound = rows.shape[1] * int(np.abs(rows).max()) * int(np.abs(columns).max())
    if bound < 1 << 53:
        return np.rint(rows @ columns.T).astype(np.int64)
    if bound < 1 << 63:
        return rows.astype(np.int64) @ columns.astype(np.int64).T
    whole = [np.array([[int(x) for x in row] for row in m], object) for m in (rows, columns)]
    return np.clip(whole[0] @ whole[1].T, LONG_MIN, LONG_MAX).astype(np.int64)
