"""Tail probabilities of t, F, chi-square and normal statistics, for numbers that Spark has already aggregated."""

from __future__ import annotations

import math


def normal_tail(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    total = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + step * d) or 1e-300)
            c = (1 + step / c) or 1e-300
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * total


def t_tail(t: float, df: float) -> float:
    """Two-sided."""
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_tail(x: float, k: float) -> float:
    """Upper tail by the series or the continued fraction of the incomplete gamma function."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 400):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or 1e-300)
        c = (b + an / c) or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h


def t_quantile(p: float, df: float) -> float:
    """Two-sided critical value: t_tail(value) = 1 - p."""
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_tail(mid, df) > 1 - p else (lo, mid)
    return (lo + hi) / 2


def binom_two_sided(k: int, n: int, p: float) -> float:
    """Sum of the probabilities of all outcomes no likelier than k."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(n + 1)]
    return min(1.0, sum(math.exp(x) for x in logs if x <= logs[k] + 1e-7))
