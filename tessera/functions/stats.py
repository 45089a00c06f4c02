"""Small-number statistics on the driver (a handful of values): tails, quantiles, least squares, rounding."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column, digits: int) -> Column:
    """Round half to even after scaling, as array libraries do."""
    return F.rint(x * 10**digits) / 10**digits


def chi2_tail(x: float, dof: int) -> float:
    """P(chi-square > x), for whole degrees of freedom, in closed form."""
    if x <= 0:
        return 1.0
    half = x / 2
    if dof % 2 == 0:
        term = total = 1.0
        for i in range(1, dof // 2):
            term *= half / i
            total += term
        return math.exp(-half) * total
    total, term = math.erfc(math.sqrt(half)), math.sqrt(half) / math.gamma(1.5)
    for i in range(1, (dof + 1) // 2):
        total += math.exp(-half) * term
        term *= half / (i + 0.5)
    return total


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c = 1e-300, 1.0
    d = 1.0 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 300):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + k * d, 1 + k / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, dof: float) -> float:
    return beta_cdf(dof / 2, 0.5, dof / (dof + t * t))


def t_quantile(p: float, dof: float) -> float:
    """Quantile of Student's t for p above one half, by bisection."""
    low, high = 0.0, 1e6
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if 1 - t_two_sided(middle, dof) / 2 < p else (low, middle)
    return (low + high) / 2


def least_squares(residual, jacobian, start: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Levenberg-Marquardt for a batch of problems: start (batch, k), residual (batch, m), jacobian (batch, m, k)."""
    p, damp = np.array(start, float), np.full(len(start), 1e-3)
    cost = (residual(p) ** 2).sum(axis=1)
    for _ in range(rounds):
        r, j = residual(p), jacobian(p)
        grad, hess = np.einsum("bmk,bm->bk", j, r), np.einsum("bmk,bml->bkl", j, j)
        diag = np.einsum("bkk->bk", hess)
        system = hess + np.einsum("b,bk,kl->bkl", damp, np.maximum(diag, 1e-12), np.eye(p.shape[1]))
        step = -np.linalg.solve(system, grad[..., None])[..., 0]
        with np.errstate(all="ignore"):
            new = (residual(p + step) ** 2).sum(axis=1)
        better = np.isfinite(new) & (new <= cost)
        gain = np.where(better, cost - new, 0.0)
        p[better] += step[better]
        cost = np.where(better, new, cost)
        damp = np.clip(np.where(better, damp / 5, damp * 4), 1e-15, 1e12)
        if (np.where(better, gain <= 1e-16 * (1 + cost), damp >= 1e10)).all():
            break
    return p
