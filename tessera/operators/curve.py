"""Learning curves: fit to a few anchor points, projection, residual bootstrap.

The fits are tiny and run on the driver with numpy; bootstrap replicates are dealt out by ``spark.range``
and refitted in batches, all replicates of a batch at once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.stats import least_squares, t_quantile

# The default anchor points (n, macro-F1).
ANCHORS = ((20, 0.37), (50, 0.60), (100, 0.70), (200, 0.72), (500, 0.72), (1000, 0.72))
TINY = 2.2250738585072014e-308


def saturating(n: Column, a: Column, b: Column) -> Column:
    return a * (1 - F.exp(-n / b))


def inverse_power(n: Column, a: Column, c: Column, d: Column) -> Column:
    return a - c * F.pow(n, -d)


def aic(residual: Column, n_params: int) -> Column:
    """Aggregate: m ln(rss / m) + 2k."""
    m = F.count(residual)
    return m * F.ln(F.greatest(F.sum(residual * residual), F.lit(TINY)) / m) + 2 * n_params


def _exponential(p, n):
    return p[..., :1] * (1 - np.exp(-n / p[..., 1:2]))


def _exponential_slope(p, n):
    e = np.exp(-n / p[..., 1:2])
    return np.stack([1 - e, -p[..., :1] * e * n / p[..., 1:2] ** 2], axis=-1)


def _power(p, n):
    return p[..., :1] - p[..., 1:2] * n ** (-p[..., 2:3])


def _power_slope(p, n):
    e = n ** (-p[..., 2:3])
    return np.stack([np.ones_like(e), -e, p[..., 1:2] * np.log(n) * e], axis=-1)


MODELS = {
    "exponential": (("a", "b"), _exponential, _exponential_slope, lambda n, f: [f.max(), float(np.median(n))]),
    "power": (("a", "c", "d"), _power, _power_slope, lambda n, f: [1.02 * f.max(), 2.0, 0.6]),
}


def _solve(model: str, n: np.ndarray, targets: np.ndarray, start: np.ndarray) -> np.ndarray:
    _, value, slope, _ = MODELS[model]
    return least_squares(lambda p: value(p, n) - targets, lambda p: slope(p, n), start)


@dataclass
class Fit:
    model: str
    n: np.ndarray
    f: np.ndarray
    params: np.ndarray
    names: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        self.names = MODELS[self.model][0]
        self.residuals = self.f - self(self.n)
        j = MODELS[self.model][2](self.params[None], self.n)[0]
        dof = len(self.n) - len(self.params)
        rss = float((self.residuals**2).sum())
        self.cov = np.linalg.pinv(j.T @ j) * rss / dof if dof > 0 else np.full((len(self.params),) * 2, math.inf)

    def __call__(self, n) -> np.ndarray:
        return MODELS[self.model][1](self.params[None], np.atleast_1d(np.asarray(n, float)))[0]

    def stderr(self) -> np.ndarray:
        return np.sqrt(np.diag(self.cov))

    def interval(self, level: float = 0.95) -> list[tuple[float, float]]:
        half = t_quantile(0.5 + level / 2, len(self.n) - len(self.params)) * self.stderr()
        return list(zip(self.params - half, self.params + half, strict=True))

    def r_squared(self) -> float:
        return 1 - float((self.residuals**2).sum() / ((self.f - self.f.mean()) ** 2).sum())

    def aic(self) -> float:
        m = len(self.n)
        return m * math.log(max(float((self.residuals**2).sum()), TINY) / m) + 2 * len(self.params)

    def imprecise_anchors(self) -> bool:
        """The residuals are below the precision of two-decimal anchors, so intervals understate the error."""
        return bool(np.abs(self.residuals).max() < 1e-3)


def fit_curve(n, f, model: str = "exponential", start=None) -> Fit:
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}")
    n, f = np.asarray(n, float), np.asarray(f, float)
    if len(n) < 3:
        raise ValueError("at least three anchor points are needed")
    start = np.array(MODELS[model][3](n, f) if start is None else start, float)
    return Fit(model, n, f, _solve(model, n, f[None], start[None])[0])


def gap_replicates(spark: SparkSession, fit: Fit, n_lighter: float, n_darker: float, n_boot: int = 2000, seed: int = 2026) -> DataFrame:
    """(rep, gap): refits to resampled residuals; a replicate depends on (seed, rep) only."""
    model, n, base, residuals, start = fit.model, fit.n, fit(fit.n), fit.residuals, fit.params

    def refit(batches):
        for pdf in batches:
            reps = pdf["id"].to_numpy()
            if not len(reps):
                continue
            draw = np.stack([np.random.default_rng([seed, int(r)]).integers(0, len(residuals), len(residuals)) for r in reps])
            p = _solve(model, n, base + residuals[draw], np.repeat(start[None], len(reps), axis=0))
            value = MODELS[model][1]
            gap = value(p, np.array([float(n_lighter)]))[:, 0] - value(p, np.array([float(n_darker)]))[:, 0]
            good = np.isfinite(gap)
            yield pdf.assign(rep=reps, gap=gap)[["rep", "gap"]][good]

    return spark.range(n_boot).mapInPandas(refit, "rep long, gap double")


def project_gap(spark: SparkSession, fit: Fit, n_lighter: float, n_darker: float, n_boot: int = 2000, seed: int = 2026) -> DataFrame:
    """One row: projected values, gap = lighter - darker, its bootstrap mean and interval (null if no refit succeeded)."""
    lighter, darker = float(fit(n_lighter)[0]), float(fit(n_darker)[0])
    boot = gap_replicates(spark, fit, n_lighter, n_darker, n_boot, seed).agg(F.avg("gap").alias("boot_mean"), F.percentile("gap", 0.025).alias("low"), F.percentile("gap", 0.975).alias("high"), F.count("*").alias("n_ok"))
    return boot.select(F.lit(lighter).alias("f_lighter"), F.lit(darker).alias("f_darker"), F.lit(lighter - darker).alias("gap"), "boot_mean", "low", "high", "n_ok")


def sensitivity(spark: SparkSession, anchors, settings: list[tuple[str, str, float, float]], n_boot: int = 2000, seed: int = 2026) -> DataFrame:
    """A row a setting (label, model, n_lighter, n_darker): gap, interval and AIC, rounded."""
    n, f = zip(*anchors, strict=True)
    out = None
    for label, model, lighter, darker in settings:
        fit = fit_curve(n, f, model)
        row = project_gap(spark, fit, lighter, darker, n_boot, seed).select(F.lit(label).alias("setting"), F.lit(model).alias("model"), *[F.round(c, 3).alias(c) for c in ("gap", "low", "high")], F.lit(round(fit.aic(), 2)).alias("aic"))
        out = row if out is None else out.unionByName(row)
    return out


def curve_grid(spark: SparkSession, fit: Fit, low: float, high: float, points: int = 600) -> DataFrame:
    """Figure data: (n, value) on an even grid."""
    n = F.lit(low) + F.col("id") * F.lit((high - low) / (points - 1))
    p = [F.lit(float(x)) for x in fit.params]
    return spark.range(points).select(n.alias("n"), (saturating(n, *p) if fit.model == "exponential" else inverse_power(n, *p)).alias("value"))
