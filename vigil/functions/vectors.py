"""Vector column expressions (JVM side) and the numpy kernel used inside
Arrow-batched pandas functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import as_col


def dot(a, b) -> Column:
    """Σ aᵢ·bᵢ with higher-order functions (no Python)."""
    return F.aggregate(F.zip_with(as_col(a), as_col(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(a) -> Column:
    return F.sqrt(F.aggregate(F.transform(as_col(a), lambda x: x * x), F.lit(0.0), lambda acc, x: acc + x))


def cosine_distance(a, b) -> Column:
    """1 − a·b/(‖a‖‖b‖); null when either vector has zero norm."""
    den = l2_norm(a) * l2_norm(b)
    return F.when(den > 0, F.lit(1.0) - dot(a, b) / den)


def l2_normalize(a) -> Column:
    """x/‖x‖ (a zero vector stays as it is)."""
    n = l2_norm(a)
    return F.when(n > 0, F.transform(as_col(a), lambda x: x / n)).otherwise(as_col(a))


def to_matrix(series) -> np.ndarray:
    """A pandas Series of equal-length arrays -> 2-D float64 matrix."""
    if len(series) == 0:
        return np.zeros((0, 0))
    return np.stack(series.to_numpy()).astype(np.float64, copy=False)


def cosine_matrix(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosine distances (|q| × |v|); NaN where a norm is zero."""
    qn = np.linalg.norm(q, axis=1)
    vn = np.linalg.norm(v, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        sim = (q @ v.T) / np.outer(qn, vn)
    sim[~np.isfinite(sim)] = np.nan
    return 1.0 - sim
