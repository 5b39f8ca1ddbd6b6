"""Two-dimensional embeddings in numpy for driver-sized inputs (guarded by ``MAX_POINTS``)."""

from __future__ import annotations

import numpy as np

MAX_POINTS = 5000


def _d2(x: np.ndarray) -> np.ndarray:
    s = (x**2).sum(1)
    d = np.maximum(s[:, None] + s[None, :] - 2 * x @ x.T, 0.0)
    np.fill_diagonal(d, 0.0)
    return d


def _affinities(d: np.ndarray, perplexity: float) -> np.ndarray:
    """Row-wise Gaussian affinities of the wanted perplexity, all rows bisected together."""
    n = len(d)
    lo, hi, beta = np.zeros(n), np.full(n, np.inf), np.ones(n) / max(np.median(d), 1e-12)
    target = np.log(perplexity)
    off = d + np.where(np.eye(n) > 0, np.inf, 0.0)
    low = off.min(1, keepdims=True)
    for _ in range(64):
        p = np.exp(-(off - low) * beta[:, None])
        s = p.sum(1)
        h = np.log(s) + beta * (np.where(np.isfinite(off), off - low, 0.0) * p).sum(1) / s
        wide = h > target
        lo, hi = np.where(wide, beta, lo), np.where(wide, hi, beta)
        beta = np.where(np.isinf(hi), beta * 2, (lo + hi) / 2)
    return p / s[:, None]


def tsne(x: np.ndarray, dims: int = 2, perplexity: float = 30.0, max_iter: int = 1000, early_stop: int = 250, exaggeration: float = 12.0, late_start: int | None = None, late_exaggeration: float = 1.0, learning_rate: float | None = None, momentum: float = 0.5, final_momentum: float = 0.8, theta: float = 0.5, df: float = 1.0, seed: int = 42) -> np.ndarray:
    """Exact t-SNE (theta is validated and ignored) with early and late exaggeration and a momentum switch.

    The learning rate defaults to points / (4 * exaggeration), between 20 and 200.
    """
    x = np.asarray(x, dtype=float)
    if x.ndim != 2:
        raise ValueError("x must be a matrix")
    if not 0 <= theta <= 1:
        raise ValueError("theta must lie in [0, 1]")
    if len(x) - 1 < 3 * perplexity:
        raise ValueError("perplexity is too large for the number of points")
    if max_iter <= 0 or early_stop != int(early_stop) or dims != int(dims) or dims <= 0:
        raise ValueError("max_iter must be positive; early_stop and dims must be whole")
    if not np.isfinite([exaggeration, df]).all():
        raise ValueError("exaggeration and df must be numbers")
    if len(x) > MAX_POINTS:
        raise ValueError(f"{len(x)} points; embed at most {MAX_POINTS} and project the rest")
    n = len(x)
    learning_rate = learning_rate or float(np.clip(n / (4 * exaggeration), 20, 200))
    p = _affinities(_d2(x), perplexity)
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    rs = np.random.RandomState(seed)
    y, vel, gain = rs.standard_normal((n, int(dims))) * 1e-4, np.zeros((n, int(dims))), np.ones((n, int(dims)))
    for it in range(int(max_iter)):
        f = exaggeration if it < early_stop else late_exaggeration if late_start is not None and it >= late_start else 1.0
        w = 1.0 / (1.0 + _d2(y) / df)
        np.fill_diagonal(w, 0.0)
        k = w ** ((df + 1) / 2) if df != 1 else w
        q = np.maximum(k / k.sum(), 1e-12)
        m = (f * p - q) * w
        grad = 4 * (m.sum(1)[:, None] * y - m @ y)
        gain = np.where(np.sign(grad) != np.sign(vel), gain + 0.2, np.maximum(gain * 0.8, 0.01))
        vel = (momentum if it < early_stop else final_momentum) * vel - learning_rate * gain * grad
        y = y + vel
        y -= y.mean(0)
    return y


def run_tsne(x: np.ndarray, perplexity: float = 30.0, use_pca: bool = True, **kw) -> np.ndarray | None:
    """t-SNE after an optional 50-component PCA; perplexity 5 is tried if the wanted one fails, else None."""
    x = np.asarray(x, dtype=float)
    if use_pca and x.shape[1] > 50:
        c = x - x.mean(0)
        u, s, _ = np.linalg.svd(c, full_matrices=False)
        x = u[:, :50] * s[:50]
    for p in (perplexity, 5.0):
        try:
            return tsne(x, perplexity=p, **kw)
        except ValueError:
            continue
    return None


def umap(x: np.ndarray, dims: int = 2, neighbours: int = 15, epochs: int = 200, min_dist: float = 0.1, n_pca: int | None = None, seed: int = 42) -> np.ndarray:
    """A compact UMAP: fuzzy kNN graph, scaled-PCA start, attraction along edges and sampled repulsion."""
    x = np.asarray(x, dtype=float)
    n = len(x)
    if n > MAX_POINTS:
        raise ValueError(f"{n} points; embed at most {MAX_POINTS} and project the rest")
    c = x - x.mean(0)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    if n_pca:
        x = (u * s)[:, :n_pca]
    k = min(neighbours, n - 1)
    d = np.sqrt(_d2(x))
    np.fill_diagonal(d, np.inf)
    nn = np.argsort(d, 1, kind="stable")[:, :k]
    dk = np.take_along_axis(d, nn, 1)
    rho, target = dk[:, :1], np.log2(max(k, 2))
    lo, hi = np.full((n, 1), 1e-6), np.full((n, 1), 1e3)
    for _ in range(64):
        mid = (lo + hi) / 2
        big = np.exp(-np.maximum(dk - rho, 0) / mid).sum(1, keepdims=True) > target
        lo, hi = np.where(big, lo, mid), np.where(big, mid, hi)
    a = np.zeros((n, n))
    np.put_along_axis(a, nn, np.exp(-np.maximum(dk - rho, 0) / hi), 1)
    a = a + a.T - a * a.T
    i, j = np.nonzero(np.triu(a, 1))
    w = a[i, j]
    y = (u * s)[:, :dims]
    y = 10 * y / max(np.abs(y).max(), 1e-12)
    rs = np.random.RandomState(seed)
    ca, cb = 1.577, 0.895  # curve of min_dist 0.1
    for ep in range(epochs):
        lr = 1.0 - ep / epochs
        pick = rs.random_sample(len(w)) < w / max(w.max(), 1e-12)
        h, t = i[pick], j[pick]
        diff = y[h] - y[t]
        d2 = (diff**2).sum(1, keepdims=True)
        g = np.clip(-2 * ca * cb * np.maximum(d2, 1e-12) ** (cb - 1) / (1 + ca * d2**cb) * diff, -4, 4)
        np.add.at(y, h, lr * g)
        np.add.at(y, t, -lr * g)
        for _ in range(3):
            r = rs.randint(0, n, len(h))
            diff = y[h] - y[r]
            d2 = (diff**2).sum(1, keepdims=True)
            np.add.at(y, h, lr * np.clip(2 * cb / ((0.001 + d2) * (1 + ca * d2**cb)) * diff, -4, 4) * (r != h)[:, None])
    return y
