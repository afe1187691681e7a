"""Scalar distribution functions used on a handful of counts (no scipy needed).

These run on the driver over per-metric numbers only (four confusion counts, a
chi-squared statistic per feature) - never over rows.
"""

from __future__ import annotations

import math


MAX_STEPS = 20_000_000


def _stirling_rest(z: float) -> float:
    """ln Gamma(z) less its leading terms (z - 1/2) ln z - z + ln(2 pi) / 2."""
    if z < 15.0:
        return math.lgamma(z) - ((z - 0.5) * math.log(z) - z + 0.5 * math.log(2 * math.pi))
    r = 1.0 / (z * z)
    return (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / z


def _log1p_less(u: float) -> float:
    """ln(1 + u) - u, without cancellation for small u."""
    if abs(u) > 0.05:
        return math.log1p(u) - u
    total, power = 0.0, u
    for k in range(2, 30):
        power *= -u
        total += power / k
        if abs(power) < 1e-18 * abs(total):
            break
    return total


def _ln_beta_front(a: float, b: float, x: float) -> float:
    """ln of x^a (1-x)^b Gamma(a+b) / (Gamma(a) Gamma(b)), stable for large a and b.

    The leading Stirling terms cancel exactly: what is left is the distance of x from a / (a + b).
    """
    n = a + b
    u, v = (n * x - a) / a, (n * (1 - x) - b) / b
    return (a * _log1p_less(u) + b * _log1p_less(v) + 0.5 * math.log(a * b / (2 * math.pi * n))
            + _stirling_rest(n) - _stirling_rest(a) - _stirling_rest(b))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """1 / (1 + d1 / (1 + d2 / ...)) of the incomplete beta (DLMF 8.17.22), by the numerators and
    denominators of its convergents, scaled as they grow."""
    p0, p1, q0, q1 = 0.0, 1.0, 1.0, 1.0
    last = 1.0
    for step in range(1, MAX_STEPS):
        m, odd = divmod(step, 2)
        if odd:
            d = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            d = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        p0, p1, q0, q1 = p1, p1 + d * p0, q1, q1 + d * q0
        if q1:
            p0, p1, q0, q1 = p0 / q1, p1 / q1, q0 / q1, 1.0
            if odd == 0 and abs(p1 - last) <= 4e-16 * abs(p1):
                return p1
            last = p1 if odd == 0 else last
    raise ArithmeticError(f"the incomplete beta of {a}, {b} at {x} has not converged")


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(_ln_beta_front(a, b, x)) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(_ln_beta_front(b, a, 1.0 - x)) * _beta_fraction(b, a, 1.0 - x) / b


def beta_ppf(q: float, a: float, b: float) -> float:
    """Inverse of I_x(a, b) in x by bisection (monotone, 200 halvings)."""
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if betainc(a, b, mid) < q:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)


def binom_sf(x: int, n: int, p: float) -> float:
    """P(X >= x) for X ~ Binomial(n, p)."""
    if x <= 0:
        return 1.0
    if x > n:
        return 0.0
    return betainc(x, n - x + 1, p)


def clopper_pearson(x: int, n: int, conf: float = 0.95) -> tuple[float, float]:
    """Exact binomial confidence interval for x successes in n trials."""
    alpha = 1.0 - conf
    lower = 0.0 if x == 0 else beta_ppf(alpha / 2, x, n - x + 1)
    upper = 1.0 if x == n else beta_ppf(1 - alpha / 2, x + 1, n - x)
    return lower, upper


def gammainc_upper(s: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(s, x): the power series of the lower one below s + 1, else
    Legendre's continued fraction by its convergents."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + s * math.log(x) - math.lgamma(s))
    if x < s + 1.0:
        term = total = 1.0 / s
        for k in range(1, MAX_STEPS):
            term *= x / (s + k)
            total += term
            if term < total * 1e-17:
                return max(0.0, 1.0 - total * front)
    else:
        p0, p1, q0, q1 = 0.0, 1.0, 1.0, x + 1.0 - s
        last = p1 / q1
        for k in range(1, MAX_STEPS):
            top, low = -k * (k - s), x + 2 * k + 1.0 - s
            p0, p1, q0, q1 = p1, low * p1 + top * p0, q1, low * q1 + top * q0
            p0, p1, q0, q1 = p0 / q1, p1 / q1, q0 / q1, 1.0
            if abs(p1 - last) <= 1e-16 * abs(p1):
                return front * p1
            last = p1
    raise ArithmeticError(f"the incomplete gamma of {s} at {x} has not converged")


def chi2_sf(stat: float, dof: int) -> float:
    """Survival function of the chi-squared distribution."""
    if dof <= 0 or stat != stat:
        return float("nan")
    return gammainc_upper(dof / 2.0, stat / 2.0)


def mcnemar_p(b: int, c: int, correct: bool = True) -> float:
    """McNemar test p-value on the two discordant counts (continuity corrected unless they are equal)."""
    if b + c == 0:
        return float("nan")
    diff = abs(b - c) - (1 if correct and b != c else 0)
    stat = diff * diff / (b + c)
    return math.erfc(math.sqrt(stat / 2.0))
