"""Distribution tails in numpy: normal, t, F, chi-squared, studentized range, Fisher's exact test."""

from __future__ import annotations

import math

import numpy as np

def _arr(*xs):
    return np.broadcast_arrays(*[np.asarray(x, dtype=float) for x in xs])


def _lgamma(x):
    """Logarithm of the gamma function for x > 0: shifted over 8, then the asymptotic series."""
    x = np.asarray(x, float)
    shift, y = np.zeros_like(x), x.copy()
    while (low := y < 8).any():
        shift = np.where(low, shift + np.log(np.where(low, y, 1.0)), shift)
        y = np.where(low, y + 1, y)
    f = 1 / (y * y)
    series = (1 / 12 - f * (1 / 360 - f * (1 / 1260 - f * (1 / 1680 - f * (1 / 1188 - f * 691 / 360360))))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def _gamma_q(a, x):
    """Regularised upper incomplete gamma function of all elements at once."""
    a, x = _arr(a, x)
    out = np.where((a > 0) & ~np.isnan(x), np.where(x <= 0, 1.0, 0.0), np.nan)
    todo = (a > 0) & (x > 0) & np.isfinite(x)
    if not todo.any():
        return out
    aa, xx = a[todo], x[todo]
    front = np.exp(aa * np.log(xx) - xx - _lgamma(aa))
    got = np.empty_like(aa)
    low = xx < aa + 1
    if low.any():  # series of the lower function
        k, y = aa[low].copy(), xx[low]
        term = total = 1 / k
        for _ in range(10_000):
            k = k + 1
            term = term * y / k
            total = total + term
            if (term <= total * 1e-17).all():
                break
        got[low] = np.maximum(0.0, 1 - front[low] * total)
    if (~low).any():  # continued fraction
        k, y, tiny = aa[~low], xx[~low], 1e-300
        b = y + 1 - k
        c, d = np.full_like(y, 1 / tiny), 1 / b
        h = d.copy()
        for i in range(1, 10_000):
            an = -i * (i - k)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(d == 0, tiny, d)
            c = b + an / c
            c = np.where(c == 0, tiny, c)
            h = h * d * c
            if (np.abs(d * c - 1) < 1e-15).all():
                break
        got[~low] = np.minimum(1.0, front[~low] * h)
    out[todo] = got
    return out


def _erfc(x):
    x = np.asarray(x, float)
    q = _gamma_q(0.5, x * x)
    return np.where(x < 0, 2 - q, q)


def norm_cdf(x):
    return 0.5 * _erfc(-np.asarray(x, float) / math.sqrt(2))


def norm_sf2(z):
    """Two-sided tail of the standard normal."""
    return _erfc(np.abs(np.asarray(z, float)) / math.sqrt(2))


def norm_ppf(p):
    """Normal quantile: rational start, then two Newton steps."""
    p = np.asarray(p, float)
    with np.errstate(all="ignore"):
        q = np.minimum(p, 1 - p)
        t = np.sqrt(-2 * np.log(np.maximum(q, 1e-300)))
        x = t - (2.30753 + 0.27061 * t) / (1 + 0.99229 * t + 0.04481 * t * t)
        for _ in range(4):
            e = 0.5 * _erfc(x / math.sqrt(2)) - q
            x = x + e * math.sqrt(2 * math.pi) * np.exp(0.5 * x * x)
        x = np.where(p < 0.5, -x, x)
        return np.where(p <= 0, -np.inf, np.where(p >= 1, np.inf, x))


def _beta_cf(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) > tiny, v, tiny)
    c = np.ones_like(x)
    d = 1 / guard(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 20_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / guard(1 + num * d)
            c = guard(1 + num / c)
            h = h * d * c
        if (np.abs(d * c - 1) < 1e-15).all():
            break
    return h


def _beta_inc(a, b, x):
    """Regularised incomplete beta function of all elements at once."""
    a, b, x = _arr(a, b, x)
    out = np.where((a > 0) & (b > 0) & ~np.isnan(x), np.where(x >= 1, 1.0, 0.0), np.nan)
    todo = (a > 0) & (b > 0) & (x > 0) & (x < 1)
    if not todo.any():
        return out
    aa, bb, xx = a[todo], b[todo], x[todo]
    front = np.exp(_lgamma(aa + bb) - _lgamma(aa) - _lgamma(bb) + aa * np.log(xx) + bb * np.log1p(-xx))
    turn = xx >= (aa + 1) / (aa + bb + 2)  # there the fraction converges fast from the other end
    p, q, y = np.where(turn, bb, aa), np.where(turn, aa, bb), np.where(turn, 1 - xx, xx)
    part = front * _beta_cf(p, q, y) / p
    out[todo] = np.where(turn, 1 - part, part)
    return out


def chi2_sf(x, df):
    x, df = _arr(x, df)
    return np.where(df > 0, _gamma_q(np.where(df > 0, df, 1.0) / 2, x / 2), np.nan)


def f_sf(f, d1, d2):
    f, a, b = _arr(f, d1, d2)
    ok = (a > 0) & (b > 0) & ~np.isnan(f)
    with np.errstate(all="ignore"):
        x = np.where(np.isposinf(f), 0.0, np.where(f <= 0, 1.0, b / (b + a * f)))
    return np.where(ok, _beta_inc(np.where(ok, b, 1.0) / 2, np.where(ok, a, 1.0) / 2, x), np.nan)


def t_sf2(t, df):
    """Two-sided tail of Student's t; infinite df is the normal."""
    t, k = _arr(t, df)
    normal = np.isinf(k)
    ok = (k > 0) & ~np.isnan(t)
    kk = np.where(ok & ~normal, k, 1.0)
    with np.errstate(all="ignore"):
        x = np.where(np.isinf(t), 0.0, kk / (kk + t * t))
    return np.where(ok, np.where(normal, norm_sf2(t), _beta_inc(kk / 2, 0.5, x)), np.nan)


def t_ppf(p, df):
    """Quantile of Student's t by bisection on the two-sided tail."""
    p, df = _arr(p, df)
    target, lo, hi = 2 * np.minimum(p, 1 - p), np.zeros(p.shape), np.full(p.shape, 1e6)
    for _ in range(100):
        mid = (lo + hi) / 2
        right = t_sf2(mid, df) > target
        lo, hi = np.where(right, mid, lo), np.where(right, hi, mid)
    return np.where(p == 0.5, 0.0, np.copysign(hi, p - 0.5))


_GL = np.polynomial.legendre.leggauss(64)


def _range_cdf(w: np.ndarray, k: float) -> np.ndarray:
    """P(range of k standard normals < w), by quadrature over the largest."""
    x, gw = _GL
    z = 8.5 * x
    dens = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    # z is the smallest value; the other k - 1 lie in (z, z + w)
    inner = np.clip(norm_cdf(z[None, :] + w[:, None]) - norm_cdf(z)[None, :], 0, 1) ** (k - 1)
    return np.clip(k * 8.5 * (gw * dens * inner).sum(1), 0, 1)


_RANGE_GRID = np.linspace(0, 60, 6001)
_range_tables: dict[float, np.ndarray] = {}


def _between(y: np.ndarray, cdf: np.ndarray) -> np.ndarray:
    """The range's distribution at y, by cubics through four points of its grid."""
    t = np.minimum(y, 59.9) * 100
    j = np.clip(np.floor(t).astype(int), 1, len(cdf) - 3)
    f = t - j
    return (-f * (f - 1) * (f - 2) * cdf[j - 1] + f * (f + 1) * (f - 1) * cdf[j + 2]) / 6 + ((f + 1) * (f - 1) * (f - 2) * cdf[j] - (f + 1) * f * (f - 2) * cdf[j + 1]) / 2


def ptukey_sf(q, k, df):
    """Upper tail of the studentized range of k means with df degrees of freedom."""
    x, gw = _GL

    def table(g: float) -> np.ndarray:
        if g not in _range_tables:
            _range_tables[g] = np.concatenate([_range_cdf(c, g) for c in np.array_split(_RANGE_GRID, 20)])
        return _range_tables[g]

    q, k, df = _arr(q, k, df)
    out = np.full(q.shape, np.nan)
    ok = ~np.isnan(q) & (k >= 2) & (df > 0)
    out[ok & (q <= 0)] = 1.0
    ok &= q > 0
    for g, d in {(g, d) for g, d in zip(k[ok].ravel(), df[ok].ravel())}:
        mine = ok & (k == g) & (df == d)
        v, cdf = q[mine], table(float(g))
        if math.isinf(d) or d > 25_000:
            out[mine] = 1 - _between(v, cdf)
            continue
        sd = 1 / math.sqrt(2 * d)  # s = sqrt(chi2 / d) is close to 1 with this spread
        lo, hi = max(1e-8, 1 - 9 * sd), 1 + 9 * sd if d > 2 else 8.0
        if d <= 8:
            lo = 1e-8
        s = (hi + lo) / 2 + (hi - lo) / 2 * x
        dens = np.exp(math.log(2) + d / 2 * math.log(d / 2) - math.lgamma(d / 2) + (d - 1) * np.log(s) - d * s * s / 2)
        out[mine] = np.clip(1 - (hi - lo) / 2 * (_between(v[:, None] * s, cdf) * (gw * dens)).sum(1), 0, 1)
    return out


def _over_six(x, step):
    """x raised over 6 and the sum of ``step`` over the values passed."""
    v = np.asarray(x, float).copy()
    r = np.zeros_like(v)
    while (low := v < 6).any():
        r = np.where(low, r + step(np.where(low, v, 1.0)), r)
        v = np.where(low, v + 1, v)
    return v, r


def digamma(x):
    v, r = _over_six(x, lambda y: 1 / y)
    f = 1 / (v * v)
    return np.log(v) - 0.5 / v - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132)))) - r


def trigamma(x):
    v, r = _over_six(x, lambda y: 1 / (y * y))
    f = 1 / (v * v)
    return r + 1 / v + f / 2 + f / v * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f / 30)))


def trigamma_inverse(y: float) -> float:
    """x with trigamma(x) = y, by bisection on a logarithmic scale."""
    lo, hi = 1e-8, 1e8
    for _ in range(200):
        mid = math.sqrt(lo * hi)
        lo, hi = (mid, hi) if float(trigamma(mid)) > y else (lo, mid)
    return math.sqrt(lo * hi)


def _fisher_block(a, b, c, d) -> tuple[np.ndarray, np.ndarray]:
    """fisher_exact of tables of whole counts: rows are tables, columns the possible first counts."""
    m, n, k = a + b, c + d, a + c
    lo, hi = np.maximum(0, k - n), np.minimum(k, m)
    x = lo[:, None] + np.arange(int((hi - lo).max()) + 1)
    real = x <= hi[:, None]
    x = np.minimum(x, hi[:, None])
    lc = lambda t, s: _lgamma(t + 1.0) - _lgamma(s + 1.0) - _lgamma(t - s + 1.0)
    logs = np.where(real, lc(m[:, None], x) + lc(n[:, None], k[:, None] - x), -np.inf)
    logs -= logs.max(1, keepdims=True)
    p = np.exp(logs)
    p /= p.sum(1, keepdims=True)
    own = p[np.arange(len(a)), (a - lo).astype(int)]
    pv = np.minimum(1.0, np.where(p <= own[:, None] * (1 + 1e-7), p, 0).sum(1))
    left, right = np.full(len(a), -50.0), np.full(len(a), 50.0)
    for _ in range(60):  # the log odds ratio at which a is the mean
        mid = (left + right) / 2
        v = logs + mid[:, None] * x
        v = np.exp(v - v.max(1, keepdims=True))
        below = (x * v).sum(1) / v.sum(1) < a
        left, right = np.where(below, mid, left), np.where(below, right, mid)
    odds = np.exp((left + right) / 2)
    odds = np.where(a == lo, 0.0, np.where(a == hi, np.inf, odds))
    return np.where(lo == hi, np.nan, odds), np.where(lo == hi, 1.0, pv)


def fisher_exact(a, b, c, d):
    """(odds ratio, two-sided p) of 2x2 tables; the odds ratio is the conditional maximum-likelihood estimate."""
    xs = _arr(a, b, c, d)
    flat = np.stack([x.ravel() for x in xs])
    odds, p = np.full(flat.shape[1], np.nan), np.full(flat.shape[1], np.nan)
    good = np.flatnonzero((flat >= 0).all(0))
    t = np.floor(flat[:, good])
    wide = np.minimum(t[0] + t[2], t[0] + t[1])
    order = good[np.argsort(wide, kind="stable")]
    at = 0
    while at < len(order):  # tables of about the same width together, of bounded size
        width = np.sort(wide)[at:] + 1
        size = max(1, int((np.arange(1, len(width) + 1) * width <= 1_000_000).sum()))
        rows = order[at : at + size]
        odds[rows], p[rows] = _fisher_block(*np.floor(flat[:, rows]))
        at += size
    return odds.reshape(xs[0].shape), p.reshape(xs[0].shape)


def wilcoxon_exact_p(u: float, n1: int, n0: int) -> float:
    """Exact two-sided p of the rank-sum statistic u without ties."""
    size = n1 * n0 + 1
    ways = np.zeros(size)
    ways[0] = 1
    for i in range(1, n1 + 1):  # product of (1 - x^(n0 + i)) / (1 - x^i)
        step = n0 + i
        if step < size:
            ways[step:] = ways[step:] - ways[:-step].copy()
        for r in range(min(i, size)):
            ways[r::i] = np.cumsum(ways[r::i])
    total = ways.sum()
    lower = ways[: int(math.floor(u)) + 1].sum() / total
    upper = ways[int(math.ceil(u)) :].sum() / total
    return float(min(1.0, 2 * min(lower, upper)))
