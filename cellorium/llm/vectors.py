"""Usable vectors of cells, and correlation over positions filled in both."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellorium.operators.relational import latest_per_key

LENGTH, LEAST_FILLED = 64, 32


def usable_vectors(df: DataFrame, key: str = "cell_id", vec: str = "exprs", order: str = "loaded_at", length: int = LENGTH, filled: int = LEAST_FILLED) -> DataFrame:
    """(key, vec ARRAY<DOUBLE>): the row delivered last of each key, if its vector is usable.

    Usable: exactly ``length`` positions, at least ``filled`` of them neither null
    nor NaN (nor infinite), and these not all equal.  NaN entries come out null.  Null keys give no row.
    """
    clean = F.transform(F.col(vec).cast("array<double>"), lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x))
    cur = latest_per_key(df.filter(F.col(key).isNotNull()), [key], order, [vec]).select(key, clean.alias(vec))
    some = F.filter(vec, lambda x: x.isNotNull())
    return cur.filter((F.size(vec) == length) & (F.size(some) >= filled) & (F.array_min(some) < F.array_max(some)))


def to_matrix(col, length: int | None = None) -> np.ndarray:
    """An Arrow or pandas column of arrays to a float matrix with NaN for null."""
    if isinstance(col, pd.Series):
        if not len(col):
            return np.zeros((0, length or LENGTH))
        return np.stack([np.asarray(v, dtype=float) for v in col])
    flat = col.flatten() if isinstance(col, pa.ListArray) else col.combine_chunks().flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(float)
    return x.reshape(len(col), -1) if len(col) else np.zeros((0, length or LENGTH))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows centred over their filled positions, empty ones at the mean, scaled to length 1."""
    m = np.isfinite(x)
    z = np.where(m, x, 0.0)
    mean = z.sum(1, keepdims=True) / np.maximum(m.sum(1, keepdims=True), 1)
    z = np.where(m, x - mean, 0.0)
    n = np.sqrt((z**2).sum(1, keepdims=True))
    return z / np.where(n > 0, n, 1.0)


def pair_pearson(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pearson correlation of row i of ``a`` with row i of ``b`` over positions filled in both; NaN if undefined."""
    m = np.isfinite(a) & np.isfinite(b)
    n = m.sum(1)
    x, y = np.where(m, a, 0.0), np.where(m, b, 0.0)
    d = np.maximum(n, 1)[:, None]
    x = np.where(m, x - x.sum(1, keepdims=True) / d, 0.0)
    y = np.where(m, y - y.sum(1, keepdims=True) / d, 0.0)
    sxx, syy = (x**2).sum(1), (y**2).sum(1)
    with np.errstate(invalid="ignore", divide="ignore"):
        r = (x * y).sum(1) / np.sqrt(sxx * syy)
    return np.where((n >= 2) & (sxx > 1e-18) & (syy > 1e-18), r, np.nan)


def cross_pearson(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pearson correlation of every row of ``a`` with every row of ``b`` over positions filled in both."""
    ma, mb = np.isfinite(a).astype(float), np.isfinite(b).astype(float)
    za, zb = np.where(ma > 0, a, 0.0), np.where(mb > 0, b, 0.0)
    n, sx, sy = ma @ mb.T, za @ mb.T, ma @ zb.T
    cov = n * (za @ zb.T) - sx * sy
    vx, vy = n * ((za**2) @ mb.T) - sx**2, n * (ma @ (zb**2).T) - sy**2
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where((n >= 2) & (vx > 1e-12) & (vy > 1e-12), cov / np.sqrt(vx * vy), np.nan)
