"""Special functions, tests and a small optimizer that the numerical kernels need (numpy only)."""

from __future__ import annotations

import math

import numpy as np


def gamma_p(a: float, x: float) -> float:
    """Regularized lower incomplete gamma: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 0.0
    lead = math.exp(min(700.0, -x + a * math.log(x) - math.lgamma(a)))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return min(1.0, total * lead)
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b) if an * d + b else 1e300
        c = b + an / c if b + an / c else 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return max(0.0, 1 - lead * h)


def chi2_sf(x: float, k: float) -> float:
    return 1.0 if x <= 0 else max(0.0, 1 - gamma_p(k / 2, x / 2))


def bisect(f, low: float, high: float, steps: int = 200) -> float | None:
    """A root between low and high, or None without a sign change."""
    a, b = f(low), f(high)
    if a == 0:
        return low
    if not (a < 0 < b or b < 0 < a):
        return None
    for _ in range(steps):
        mid = (low + high) / 2
        if (f(mid) < 0) == (a < 0):
            low = mid
        else:
            high = mid
    return (low + high) / 2


def chi2_quantile(p: float, k: float) -> float:
    return bisect(lambda x: gamma_p(k / 2, x / 2) - p, 0.0, 100 + 20 * k)


def digamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out -= 1 / x
        x += 1
    f = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out += 1 / (x * x)
        x += 1
    f = 1 / (x * x)
    return out + 1 / x + f / 2 + f / x * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f / 30)))


def gamma_shape(log_gap: float) -> float | None:
    """k with ln k - digamma(k) = log_gap, the gap of ln(mean) and mean(ln)."""
    if not log_gap > 0:
        return None
    k = (3 - log_gap + math.sqrt((log_gap - 3) ** 2 + 24 * log_gap)) / (12 * log_gap)
    for _ in range(50):
        step = (math.log(k) - digamma(k) - log_gap) / (1 / k - trigamma(k))
        k = k - step if k - step > 0 else k / 2
        if abs(step) < 1e-14 * k:
            break
    return k


def ks_p_value(d: float, n: int) -> float:
    """Asymptotic tail of the one-sample statistic, with the usual small-sample shift."""
    x = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * x * x) for j in range(1, 101))))


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_quantile(p: float) -> float:
    return bisect(lambda x: normal_cdf(x) - p, -40.0, 40.0)


def descend(x0: np.ndarray, steps: int = 200, tol: float = 1e-7):
    """Quasi-Newton descent (inverse-Hessian updates, backtracking) as a generator: it yields points, is sent (value, gradient), and returns (x, value)."""
    x = np.asarray(x0, float)
    v, g = yield x
    h = np.eye(len(x))
    for _ in range(steps):
        if not np.isfinite(v) or np.abs(g).max() < tol * max(1.0, abs(v)):
            break
        d = -h @ g
        if d @ g >= 0:
            h, d = np.eye(len(x)), -g
        d *= min(1.0, 2.0 / max(np.abs(d).max(), 1e-300))
        t = 1.0
        while t > 1e-12:
            new, ng = yield x + t * d
            if np.isfinite(new) and new <= v + 1e-4 * t * (d @ g):
                break
            t /= 2
        else:
            break
        s, y = t * d, ng - g
        done = abs(v - new) < 1e-12 * max(1.0, abs(v))
        x, v, g = x + s, new, ng
        if s @ y > 1e-12:
            r = 1 / (s @ y)
            a = np.eye(len(x)) - r * np.outer(s, y)
            h = a @ h @ a.T + r * np.outer(s, s)
        if done:
            break
    return x, v


def minimize(f, x0: np.ndarray, steps: int = 200, tol: float = 1e-7) -> tuple[np.ndarray, float]:
    """The descent of f giving (value, gradient)."""
    way = descend(x0, steps, tol)
    x = next(way)
    try:
        while True:
            x = way.send(f(x))
    except StopIteration as end:
        return end.value
