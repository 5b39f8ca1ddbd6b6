"""Binarising expression by one-dimensional mixtures, and outliers by extreme values; one model per key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from cellorium.functions import special


def _log_norm(x, mu, var):
    return -0.5 * (np.log(2 * np.pi * var) + (x - mu) ** 2 / var)


def fit_mixture(x: np.ndarray, g: int, equal: bool, rounds: int = 300) -> dict | None:
    """EM from quantile groups over all values, equal ones by their count; components in order of mean.  None if a component dies."""
    v, w = np.unique(x, return_counts=True)
    if len(v) < g or len(x) <= g:
        return None
    ends = np.cumsum(w)
    upto = np.cumsum([len(x) // g + (j < len(x) % g) for j in range(g)])
    z = np.diff(np.clip(upto, (ends - w)[:, None], ends[:, None]), axis=1, prepend=(ends - w)[:, None]) / w[:, None]
    floor = max(1e-10, 1e-6 * x.var())
    last = -np.inf
    for _ in range(rounds):
        zw = z * w[:, None]
        n = zw.sum(0)
        if (n < 1e-6).any():
            return None
        pi, mu = n / len(x), zw.T @ v / n
        var = (zw * (v[:, None] - mu) ** 2).sum(0) / n
        var = np.full(g, (var * n).sum() / len(x)) if equal else var
        var = np.maximum(var, floor)
        lp = np.log(pi) + _log_norm(v[:, None], mu, var)
        top = lp.max(1, keepdims=True)
        ll = float(w @ (top[:, 0] + np.log(np.exp(lp - top).sum(1))))
        z = np.exp(lp - top)
        z /= z.sum(1, keepdims=True)
        if abs(ll - last) < 1e-8 * (1 + abs(ll)):
            break
        last = ll
    o = np.argsort(mu, kind="stable")
    k = 2 * g - 1 + (1 if equal else g) if g > 1 else 2
    if g > 1 and equal:
        k = 2 * g
    elif g > 1:
        k = 3 * g - 1
    return {"pi": pi[o], "mu": mu[o], "var": var[o], "bic": 2 * ll - k * np.log(len(x)), "g": g}


def best_mixture(x: np.ndarray, gs=range(1, 10)) -> dict | None:
    fits = [f for g in gs for e in (True, False) if (g > 1 or e) and (f := fit_mixture(x, g, e)) is not None]
    return max(fits, key=lambda f: f["bic"]) if fits else None


def posterior_class(x: np.ndarray, fit: dict) -> np.ndarray:
    """Component (from 1) of largest posterior."""
    return (np.log(fit["pi"]) + _log_norm(x[:, None], fit["mu"], fit["var"])).argmax(1) + 1


def qq_r2(x: np.ndarray, fit: dict) -> float:
    """Squared correlation of the order statistics with the mixture's quantiles."""
    x = np.sort(x)
    n = len(x)
    a = 3 / 8 if n <= 10 else 1 / 2
    p = (np.arange(1, n + 1) - a) / (n + 1 - 2 * a)
    sd = np.sqrt(fit["var"])
    lo, hi = np.full(n, (fit["mu"] - 10 * sd).min()), np.full(n, (fit["mu"] + 10 * sd).max())
    for _ in range(60):
        mid = (lo + hi) / 2
        c = (fit["pi"] * special.norm_cdf((mid[:, None] - fit["mu"]) / sd)).sum(1)
        lo, hi = np.where(c < p, mid, lo), np.where(c < p, hi, mid)
    q = (lo + hi) / 2
    return float(np.corrcoef(x, q)[0, 1] ** 2) if n > 2 and x.std() > 0 and q.std() > 0 else np.nan


def binarize_vector(x: np.ndarray, g: int | None = None, top_hi: int = 1, threshold: float | None = None, zero_low: bool = True, zero_not_used: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(state in {0, 0.5, 1, -1}, component): -1 for values not usable, and for all if fewer than three are.

    g None: the number of components by BIC, the upper ``top_hi`` are 1 (0: those with
    positive mean).  g = 3: the middle component is 0.5 unless it overlaps a
    neighbour by more than a third (three standard deviations each), then it joins
    it.  g = 2: 0 and 1.  Other g: the component numbers.
    """
    x = np.asarray(x, dtype=float)
    ok = np.isfinite(x) & ((x > 0) | (not zero_not_used))
    comp, state = np.full(len(x), -1.0), np.full(len(x), -1.0)
    if threshold is not None:
        state[ok] = (x[ok] > threshold).astype(float)
        return state, comp
    fit = None
    if ok.sum() >= 3:
        fit = best_mixture(x[ok]) if g is None else max((f for e in (True, False) if (f := fit_mixture(x[ok], g, e))), key=lambda f: f["bic"], default=None)
    if fit is not None:
        c = posterior_class(x[ok], fit)
        comp[ok] = c
        k = fit["g"]
        if g is None:
            cut = k - top_hi if top_hi else k - int((fit["mu"] > 0).sum())
            state[ok] = (c > cut).astype(float)
        elif g == 3:
            sd = np.sqrt(fit["var"])
            lo, hi = fit["mu"] - 3 * sd, fit["mu"] + 3 * sd
            share = lambda i, j: max(0.0, min(hi[i], hi[j]) - max(lo[i], lo[j])) / max(hi[1] - lo[1], 1e-12)
            a, b = share(0, 1), share(1, 2)
            mid = 0.0 if a > 0.3333 and a >= b else 1.0 if b > 0.3333 else 0.5
            state[ok] = np.choose(c - 1, [0.0, mid, 1.0])
        elif g == 2:
            state[ok] = c - 1.0
        else:
            state[ok] = c
        if zero_low:
            state[np.isfinite(x) & (x <= 0) & ~ok] = 0.0
    return state, comp


def binarize(df: DataFrame, key: str, sample: str, x: str, **kw) -> DataFrame:
    """(key, sample, x, state, component) for every key; repeated samples keep their rows.

    One model per key, fitted on all its values in its group's task; the work per
    key grows with its distinct values.
    """
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s, c = binarize_vector(pdf[x].to_numpy(dtype=float, na_value=np.nan), **kw)
        return pd.DataFrame({key: pdf[key], sample: pdf[sample], x: pdf[x], "state": s, "component": c})

    return df.select(key, sample, x).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {sample} {kinds[sample]}, {x} double, state double, component double")


def outlier_limits(x: np.ndarray, rho: float = 1.0) -> tuple[float, float, float]:
    """(left, right, R2): limits beyond which fewer than ``rho`` of the values are expected under a normal law fitted to the central order statistics (0.1 to 0.9)."""
    x = np.sort(x)
    n = len(x)
    p = np.arange(1, n + 1) / (n + 1)
    mid = (p >= 0.1) & (p <= 0.9)
    if mid.sum() < 3 or np.ptp(x[mid]) == 0:
        return -np.inf, np.inf, np.nan
    q = special.norm_ppf(p[mid])
    sd, mu = np.polyfit(q, x[mid], 1)
    r2 = float(np.corrcoef(q, x[mid])[0, 1] ** 2)
    lim = float(special.norm_ppf(min(rho / n, 0.5)))
    return float(mu + sd * lim), float(mu - sd * lim), r2


def classify_outliers(df: DataFrame, key: str, sample: str, x: str, rho: float = 1.0) -> DataFrame:
    """(key, sample, x, outlier INT, limit_right, r2): 1 for values over the right limit; unusable values 0."""
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf[x].to_numpy(dtype=float, na_value=np.nan)
        ok = np.isfinite(v)
        _, right, r2 = outlier_limits(v[ok], rho) if ok.sum() >= 3 else (0.0, np.inf, np.nan)
        return pd.DataFrame({key: pdf[key], sample: pdf[sample], x: v, "outlier": (ok & (np.where(ok, v, -np.inf) > right)).astype(np.int32), "limit_right": right, "r2": r2})

    return df.select(key, sample, x).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {sample} {kinds[sample]}, {x} double, outlier int, limit_right double, r2 double")
