"""The log normaliser of the von Mises-Fisher density and inverses of the ratio of Bessel functions, without SciPy."""

from __future__ import annotations

import math

import numpy as np


def log_bessel_i(v: float, x: float) -> float:
    """ln I_v(x) for x > 0, by its power series in logarithms."""
    half, term, terms, k = math.log(x / 2), -math.lgamma(v + 1), [], 0
    top = -math.inf
    while True:
        value = term + (v + 2 * k) * half
        terms.append(value)
        top = max(top, value)
        if k > x / 2 and value < top - 45:
            break
        k += 1
        term -= math.log(k) + math.log(v + k)
    return top + math.log(math.fsum(math.exp(t - top) for t in terms))


def bessel_ratio(v: float, x: float) -> float:
    """I_{v+1}(x) / I_v(x)."""
    return math.exp(log_bessel_i(v + 1, x) - log_bessel_i(v, x)) if x > 0 else 0.0


#: Smallest logarithm of a positive double; below it the Bessel function counts as zero.
_UNDERFLOW = -745.13
#: Concentration above which the normaliser is integrated, by the dimension: fixed values, and the number of steps.
_SWITCH, _STEPS = ((1200, 500.0), (1800, 650.0)), 1000


def log_normaliser(kappa: float, d: int) -> float:
    """ln c_d(kappa) without its constant: (d/2 - 1) ln kappa - ln I_{d/2-1}(kappa), as single precision.

    Above a switch point the value there is continued by a midpoint sum over an approximation of the Bessel ratio.
    """
    if not kappa > 0:
        return math.nan
    at = next((k for most, k in _SWITCH if d < most), None)
    if at is None:
        raise ValueError(f"dimension {d} is too high: the normaliser is defined below {_SWITCH[-1][0]}")
    order = d / 2 - 1

    def direct(k: float) -> float:
        log_i = log_bessel_i(order, k)
        return order * math.log(k) - log_i if log_i > _UNDERFLOW else math.inf

    if kappa <= at:
        return float(np.float32(direct(kappa)))
    step = (kappa - at) / _STEPS
    mid = at + (np.arange(_STEPS) + 0.5) * step
    half = (d - 1) / 2
    ratio = mid / (half + np.sqrt(half * half + mid * mid))
    return float(np.float32(direct(at) - float(ratio.sum()) * step))


def inverse_ratio(r: float, d: int) -> float:
    """kappa with I_{d/2}(kappa) / I_{d/2-1}(kappa) = r, by bisection around the closed form."""
    if not 0 < r < 1:
        return 0.0 if r <= 0 else math.inf
    guess = r * (d - r * r) / (1 - r * r)
    low, high = guess / 4, guess * 4 + 1
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if bessel_ratio(d / 2 - 1, mid) < r else (low, mid)
        if high - low < 1e-10 * high:
            break
    return (low + high) / 2
