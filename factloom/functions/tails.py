"""Tail probabilities of the normal, chi-square, t and F distributions.

Applied to a handful of aggregated statistics, never to data rows.
"""

from __future__ import annotations

import math


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def _gamma_series(a: float, x: float) -> float:
    term = total = 1.0 / a
    n = a
    for _ in range(100_000):
        n += 1.0
        term *= x / n
        total += term
        if abs(term) < abs(total) * 1e-16:
            break
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _gamma_fraction(a: float, x: float) -> float:
    """Upper incomplete gamma by a continued fraction (modified Lentz)."""
    tiny = 1e-300
    b = x + 1.0 - a
    c = 1.0 / tiny
    d = 1.0 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        step = d * c
        h *= step
        if abs(step - 1.0) < 1e-15:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_sf(x: float, dof: float) -> float:
    if dof <= 0:
        return 1.0
    if x <= 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    a, half = dof / 2.0, x / 2.0
    if half < a + 1.0:
        return min(1.0, max(0.0, 1.0 - _gamma_series(a, half)))
    return min(1.0, max(0.0, _gamma_fraction(a, half)))


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c = 1.0
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1.0 + even * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + even / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + odd * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + odd / c
        c = c if abs(c) > tiny else tiny
        step = d * c
        h *= step
        if abs(step - 1.0) < 1e-15:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, dof: float) -> float:
    if math.isinf(t):
        return 0.0
    return beta_cdf(dof / (dof + t * t), dof / 2.0, 0.5)


def f_sf(f: float, d1: float, d2: float) -> float:
    if f <= 0:
        return 1.0
    if math.isinf(f):
        return 0.0
    return beta_cdf(d2 / (d2 + d1 * f), d2 / 2.0, d1 / 2.0)


def t_critical(dof: float, two_sided: float = 0.05) -> float:
    """The t whose two-sided tail equals ``two_sided``, by bisection."""
    low, high = 0.0, 1.0
    while t_two_sided(high, dof) > two_sided:
        high *= 2.0
    for _ in range(200):
        mid = (low + high) / 2.0
        if t_two_sided(mid, dof) > two_sided:
            low = mid
        else:
            high = mid
    return (low + high) / 2.0


def mann_whitney_exact(u: float, n1: int, n2: int) -> float:
    """Two-sided exact p for the larger U, no ties."""
    small, large = min(n1, n2), max(n1, n2)
    size = small * large + 1
    ways = [0] * size
    ways[0] = 1
    for i in range(1, small + 1):
        top = large + i
        for s in range(size - 1, top - 1, -1):
            ways[s] -= ways[s - top]
        for s in range(i, size):
            ways[s] += ways[s - i]
    total = math.comb(n1 + n2, small)
    tail = sum(ways[math.ceil(u) :])
    return min(1.0, 2.0 * tail / total)
