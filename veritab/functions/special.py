"""Tail probabilities on the driver, from a handful of aggregated numbers.

The incomplete beta and gamma functions are evaluated by Lentz's continued fractions and power series.
"""

from __future__ import annotations

import math
from functools import lru_cache

EPS, TINY = 1e-15, 1e-300


def _lentz(step, start: float, most: int = 500) -> float:
    """Continued fraction start + a1/(b1 + a2/(b2 + ...)); ``step(i)`` gives (a, b)."""
    f = start or TINY
    c, d = f, 0.0
    for i in range(1, most):
        a, b = step(i)
        d = b + a * d or TINY
        c = b + a / c or TINY
        d = 1 / d
        f *= c * d
        if abs(c * d - 1) < EPS:
            break
    return f


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)

    def step(i: int) -> tuple[float, float]:
        m = i // 2
        if i % 2:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    return front / _lentz(step, 1.0)


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * EPS:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    return front / _lentz(lambda i: (-i * (i - a), x + 2 * i + 1 - a), x + 1 - a)


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_tail(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def fisher_interval(r: float, n: int) -> tuple[float, float] | None:
    """95 % interval of a correlation by Fisher's z; none below four pairs or at |r| = 1."""
    if n < 4 or abs(r) >= 1:
        return None
    z, half = math.atanh(r), 1.96 / math.sqrt(n - 3)
    return math.tanh(z - half), math.tanh(z + half)


@lru_cache(maxsize=4096)
def _ways(u: int, m: int, n: int) -> int:
    """Orders of m and n untied values whose U statistic is u."""
    if u < 0 or m < 0 or n < 0:
        return 0
    if m == 0 or n == 0:
        return int(u == 0)
    return _ways(u - n, m - 1, n) + _ways(u, m, n - 1)


def mann_whitney_p(u: float, m: int, n: int, tie_sum: float) -> float:
    """Two-sided; exact for a sample of at most eight without ties, else normal with tie and continuity correction.

    ``tie_sum`` is the sum of t**3 - t over groups of equal values.
    """
    high = max(u, m * n - u)
    if tie_sum == 0 and min(m, n) <= 8 and m + n <= 60:
        tail = sum(_ways(k, m, n) for k in range(int(math.ceil(high)), m * n + 1))
        return min(1.0, 2 * tail / math.comb(m + n, m))
    total = m + n
    var = m * n / 12 * (total + 1 - tie_sum / (total * (total - 1)))
    return min(1.0, normal_two_sided(max(0.0, high - m * n / 2 - 0.5) / math.sqrt(var))) if var > 0 else 1.0
