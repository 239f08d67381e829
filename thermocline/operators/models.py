"""Models: regressions with autocorrelation-robust errors, load response, predictive mixtures."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

from thermocline.operators import stats as S
from thermocline.operators.stats import mixture_cdf, mixture_crps, mixture_quantiles


def least_squares(x: np.ndarray, y: np.ndarray, lags: int) -> dict:
    """Coefficients with Newey-West errors: Bartlett weights, no small-sample factor.

    By singular values; directions without weight get none. The Bartlett-weighted covariance of the
    scores is the mean outer product of their sums over every window of lags + 1 rows, windows that
    hang over either end included.
    """
    left, size, right = np.linalg.svd(x, full_matrices=False)
    inverse = np.divide(1, size, out=np.zeros_like(size), where=size > size.max() * max(x.shape) * np.finfo(float).eps)
    beta = right.T @ (inverse * (left.T @ y))
    resid = y - x @ beta
    influence = (right.T * inverse) @ (left * resid[:, None]).T  # of each row on the coefficients
    upto = np.cumsum(np.pad(influence, ((0, 0), (1, lags))), axis=1) if lags else np.cumsum(np.pad(influence, ((0, 0), (1, 0))), axis=1)
    ends = np.arange(1, influence.shape[1] + lags + 1)
    window = upto[:, ends] - upto[:, np.maximum(ends - lags - 1, 0)]
    variance = (window**2).sum(1) / (lags + 1)
    total = float(((y - y.mean()) ** 2).sum())
    return {"beta": beta, "se": np.sqrt(variance), "resid": resid, "r2": 1 - float(resid @ resid) / total if total > 0 else 0.0}


def load_fit(rows: pd.DataFrame, y: str, drivers: dict[float, tuple[str, str]], lags: int = 0, least: int = 36) -> dict | None:
    """The response of log load to heating and cooling, with year and month effects.

    drivers gives (heating, cooling) columns for each billing weight; the weight with the least
    squared error is chosen, the first of equal ones. None with fewer than `least` whole rows.
    """
    whole = rows.dropna(subset=[y, *(c for pair in drivers.values() for c in pair)])
    if len(whole) < least:
        return None
    years = np.unique(whole["year"])
    effects = np.hstack([whole["year"].to_numpy()[:, None] == years, whole["month"].to_numpy()[:, None] == np.arange(2, 13)]).astype(float)
    best = None
    for weight, pair in drivers.items():
        fit = least_squares(np.hstack([effects, whole[list(pair)].to_numpy(float)]), whole[y].to_numpy(float), lags)
        sse = float(fit["resid"] @ fit["resid"])
        if best is None or sse < best["sse"] - 1e-12:
            best = {"billing_weight": weight, "sse": sse, "heating": fit["beta"][-2], "cooling": fit["beta"][-1], "heating_se": fit["se"][-2], "cooling_se": fit["se"][-1], "r2": fit["r2"], "n": len(whole), "level": dict(zip(years.tolist(), fit["beta"][: len(years)], strict=True)), "season": np.append(0.0, fit["beta"][len(years) : len(years) + 11])}
    return best


def linear_forecast(x: np.ndarray, y: np.ndarray, x0: float, sigma: float = 0.0) -> tuple[float, float]:
    """(mean, sd) of a one-point normal forecast: residual variance with two degrees less plus sigma squared."""
    slope, intercept = np.polyfit(x, y, 1)
    resid = y - intercept - slope * x
    return float(intercept + slope * x0), math.sqrt(float(resid @ resid) / max(len(y) - 2, 1) + sigma**2)


def summary(mu: np.ndarray, w: np.ndarray, sigma: float, observed: float | None = None, interval: float = 0.8) -> dict:
    """Mean, quantiles, chance above zero and, with an observation, score, PIT and coverage."""
    low, high = (1 - interval) / 2, (1 + interval) / 2
    lo, median, hi = map(float, mixture_quantiles(mu, w, sigma, [low, 0.5, high]))
    out = {"mean": float(np.average(mu, weights=w)), "lo": lo, "median": median, "hi": hi, "prob_above": 1 - mixture_cdf(mu, w, sigma, 0.0)}
    if observed is not None:
        out |= {"observed": observed, "crps": mixture_crps(mu, w, sigma, observed), "pit": mixture_cdf(mu, w, sigma, observed), "covered": bool(lo <= observed <= hi)}
    return out


def propagated(mu: np.ndarray, intercept: float, slope: float, sigma: float, sd: float) -> tuple[np.ndarray, float]:
    """A mixture put through a regression with error: again a mixture."""
    return intercept + slope * np.asarray(mu), math.sqrt((slope * sigma) ** 2 + sd**2)


def alias_table(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(share, other) of weighted draws in constant time: place k keeps a draw with chance share[k], else other[k] takes it."""
    share = np.asarray(w, float) / np.sum(w) * len(w)
    other, small, large = np.arange(len(w)), [k for k in range(len(w)) if share[k] < 1], [k for k in range(len(w)) if share[k] >= 1]
    while small and large:
        k, rich = small.pop(), large[-1]
        other[k] = rich
        share[rich] -= 1 - share[k]
        if share[rich] < 1:
            small.append(large.pop())
    share[small + large] = 1.0  # what rounding has left
    return share, other


def draws(mu: np.ndarray, w: np.ndarray, sigma: float, key: int, count: int, seed: int = 0) -> np.ndarray:
    """`count` draws of a normal mixture. Draw n follows from (key, n, seed) alone, wherever it is made."""
    place, keep, one, two = S.uniforms(np.array([key]), np.arange(4 * count), seed)[0].reshape(4, count)
    share, other = alias_table(w)
    at = (place * len(share)).astype(int)
    at = np.where(keep < share[at], at, other[at])
    return np.asarray(mu, float)[at] + sigma * np.sqrt(-2 * np.log(one)) * np.cos(2 * np.pi * two)
