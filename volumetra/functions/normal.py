"""The standard normal distribution, from the standard library."""

from __future__ import annotations

import math
from statistics import NormalDist

_N = NormalDist()


def cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def sf(x: float) -> float:
    """Upper tail, accurate far out."""
    return 0.5 * math.erfc(x / math.sqrt(2))


def ppf(p: float) -> float:
    return -math.inf if p <= 0 else math.inf if p >= 1 else _N.inv_cdf(p)


def isf(p: float) -> float:
    """Inverse upper tail, refined by Newton steps so that tiny p keep their accuracy."""
    if p <= 0:
        return math.inf
    if p >= 1:
        return -math.inf
    x = math.sqrt(max(0.0, -2 * math.log(p))) if p < 1e-300 else -_N.inv_cdf(p)
    for _ in range(8):
        d = math.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)
        if d == 0:
            break
        x += (sf(x) - p) / d
    return x
