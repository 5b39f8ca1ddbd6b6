"""Knee of a descending curve."""

from __future__ import annotations

import numpy as np


def find_knee(y, corrected: bool = False) -> int:
    """Number of components at the point farthest from the chord of the curve.

    Up to three values: their number.  The position is counted inside the inner
    points 2..n-1, so it is one less than the point's own index; that is the
    customary result and the default.  ``corrected`` gives the index itself.
    """
    y = np.asarray(y, dtype=float)
    n = len(y)
    if n <= 3:
        return n
    a, b = np.array([1.0, y[0]]), np.array([float(n), y[-1]])
    d = (b - a) / np.linalg.norm(b - a)
    p = np.c_[np.arange(2, n), y[1:-1]] - a
    dist = np.abs(p[:, 0] * d[1] - p[:, 1] * d[0])
    return int(dist.argmax()) + (2 if corrected else 1)
