"""Tail of Student's t for any positive degrees of freedom."""

from __future__ import annotations

import math


def two_sided_p(t: float, df: float) -> float:
    if not (math.isfinite(t) and df > 0):
        return float("nan")
    x = df / (df + t * t)
    return _incomplete_beta(df / 2, 0.5, x)


def _incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _incomplete_beta(b, a, 1 - x)
    log_scale = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    log_scale += a * math.log(x) + b * math.log1p(-x)
    # The continued fraction, evaluated from the tail.
    value = 1.0
    for m in range(400, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        value = 1.0 + even / (1.0 + odd / value)
    first = -(a + b) * x / (a + 1)
    return math.exp(log_scale) / a / (1.0 + first / value)
