"""Dense pieces that metric learners share."""

from __future__ import annotations

import numpy as np

#: Eigenvalues under ZERO become EPS in a repair.
ZERO, EPS = 1e-10, 1e-6


def psd(m: np.ndarray, zero: float = ZERO, eps: float = EPS) -> np.ndarray:
    """m if it has a Cholesky factor, else m with its small eigenvalues lifted."""
    m = (m + m.T) / 2
    try:
        np.linalg.cholesky(m)
        return m
    except np.linalg.LinAlgError:
        values, vectors = np.linalg.eigh(m)
        return (vectors * np.where(values < zero, eps, values)) @ vectors.T


def inverse(m: np.ndarray) -> np.ndarray:
    """The inverse, the pseudo-inverse of a singular matrix."""
    try:
        if np.linalg.cond(m) < 1 / np.finfo(float).eps:
            return np.linalg.inv(m)
    except np.linalg.LinAlgError:
        pass
    return np.linalg.pinv(m)


def factor(m: np.ndarray) -> np.ndarray:
    """L with m = L' L for a positive semidefinite m."""
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    return np.sqrt(np.maximum(values, 0))[:, None] * vectors.T


def cells(spark, m: np.ndarray):
    """The matrix as a table i, j, v."""
    d = len(m)
    return spark.createDataFrame([(i, j, float(m[i, j])) for i in range(d) for j in range(d)], "i int, j int, v double")
