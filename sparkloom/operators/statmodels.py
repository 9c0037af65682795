"""Statistical forecasters in numpy, one group of a grouped map for each series and fold.

A group is one series' training rows; series are split by key, so a panel of any number of
them spreads over tasks. A series that a method cannot fit takes the seasonal last values,
and says so in the column fallback.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.session import shipped

SCHEMA = "model string, fold int, series string, step int, yhat double, lo double, hi double, fallback boolean"


def seasonal_last(y: np.ndarray, h: int, m: int) -> np.ndarray:
    m = m if len(y) > m else 1
    return np.array([y[len(y) - m + (k % m)] for k in range(h)])


def fit_ets(y: np.ndarray, h: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Additive errors, damped additive trend, additive season if there are two of them and ten more; (means, sds)."""
    season = m > 1 and len(y) >= 2 * m + 10
    base = np.array([y[i::m][:2].mean() for i in range(m)]) if season else np.zeros(1)
    s0 = base - base.mean() if season else base

    def run(p: np.ndarray) -> tuple[float, np.ndarray, float, float]:
        a, b, g, phi = p
        level, trend, s = y[: max(1, m if season else 1)].mean(), 0.0, s0.copy()
        sse = 0.0
        for t, v in enumerate(y):
            k = t % m if season else 0
            e = v - (level + phi * trend + s[k])
            level, trend = level + phi * trend + a * e, phi * trend + a * b * e
            if season:
                s[k] += g * e
            sse += e * e
        return sse, s, level, trend

    best, lowest = np.array([0.3, 0.1, 0.1, 0.95]), math.inf
    low, high, step = np.array([0.01, 0.0, 0.0, 0.8]), np.array([0.99, 0.99, 0.9, 0.98]), np.array([0.2, 0.1, 0.1, 0.05])
    while step.max() > 0.01:  # coordinate search
        moved = False
        for i in range(4 if season else 4):
            for sign in (1, -1):
                p = best.copy()
                p[i] = np.clip(p[i] + sign * step[i], low[i], high[i])
                sse = run(p)[0]
                if sse < lowest - 1e-12:
                    best, lowest, moved = p, sse, True
        if not moved:
            step = step / 2
    sse, s, level, trend = run(best)
    a, b, g, phi = best
    sd = math.sqrt(sse / max(1, len(y) - 4))
    means, spread, damp, weight = np.empty(h), np.empty(h), 0.0, 1.0
    for k in range(h):
        damp += phi ** (k + 1)
        means[k] = level + damp * trend + (s[(len(y) + k) % m] if season else 0.0)
        spread[k] = sd * math.sqrt(weight)
        c = a * (1 + b * sum(phi**j for j in range(1, k + 2))) + (g if season and (k + 1) % m == 0 else 0.0)
        weight += c * c
    return means, spread


def fit_theta(y: np.ndarray, h: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Exponential smoothing plus half of the linear trend, on a series without its season."""
    season = np.zeros(1)
    if m > 1 and len(y) >= 2 * m + 10:
        season = np.array([y[i::m].mean() for i in range(m)]) - y.mean()
    x = y - np.array([season[t % len(season)] for t in range(len(y))])
    t = np.arange(len(x))
    slope = np.polyfit(t, x, 1)[0]

    def smooth(alpha: float) -> tuple[float, float]:
        level, sse = x[0], 0.0
        for v in x[1:]:
            e = v - level
            sse += e * e
            level += alpha * e
        return sse, level

    alpha = min((k / 50 for k in range(1, 50)), key=lambda a: smooth(a)[0])
    sse, level = smooth(alpha)
    sd = math.sqrt(sse / max(1, len(x) - 1))
    k = np.arange(1, h + 1)
    drift = slope / 2 * (k - 1 + (1 - (1 - alpha) ** len(x)) / alpha)
    means = level + drift + np.array([season[(len(y) + i) % len(season)] for i in range(h)])
    return means, sd * np.sqrt(1 + (k - 1) * alpha**2)


def differenced(y: np.ndarray, m: int) -> tuple[np.ndarray, bool, bool]:
    """(values, whether by season, whether by step): of the four ways to difference, that with the smallest deviation, of near equal ones the plainest. A season counts from two to sixty steps, if there are three of them."""
    ways = [(y, False, False), (np.diff(y), False, True)]
    if 1 < m <= 60 and len(y) > 3 * m:
        by = y[m:] - y[:-m]
        ways += [(by, True, False), (np.diff(by), True, True)]
    least = min(x.std() for x, *_ in ways)
    return next(w for w in ways if w[0].std() <= 1.05 * least + 1e-12)


#: Orders of autoregression and moving average that are tried: each up to MOST_ORDER, both together up to MOST_ORDERS.
MOST_ORDER, MOST_ORDERS = 2, 3


def fit_arima(y: np.ndarray, h: int, m: int, most: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """ARMA by two-step least squares on differenced values, orders by AIC; a season of up to 60 enters by its difference."""
    y = y[-most:]
    x, seasonal, d = differenced(y, m)
    mean = x.mean()
    z = x - mean
    long = min(10, max(1, len(z) // 10))
    lagged = lambda v, k: np.column_stack([v[k - 1 - i : len(v) - 1 - i] for i in range(k)])
    ar, *_ = np.linalg.lstsq(lagged(z, long), z[long:], rcond=None)
    noise = np.concatenate([np.zeros(long), z[long:] - lagged(z, long) @ ar])
    best = None
    for p, q in ((p, q) for p in range(MOST_ORDER + 1) for q in range(MOST_ORDER + 1) if p + q <= MOST_ORDERS):
        k = max(p, q, 1)
        parts = [z[k - 1 - i : len(z) - 1 - i] for i in range(p)] + [noise[k - 1 - i : len(z) - 1 - i] for i in range(q)]
        design = np.column_stack(parts) if parts else np.zeros((len(z) - k, 0))
        beta = np.linalg.lstsq(design, z[k:], rcond=None)[0] if parts else np.zeros(0)
        e = z[k:] - design @ beta
        aic = len(e) * math.log(max(e @ e / len(e), 1e-12)) + 2 * (p + q + 1)
        if best is None or aic < best[0]:
            best = (aic, p, q, beta, e)
    _, p, q, beta, e = best
    sd, psi = e.std(), [1.0]
    zs, es = list(z), list(np.concatenate([np.zeros(len(z) - len(e)), e]))
    out = []
    for k in range(h):
        v = sum(beta[i] * zs[-1 - i] for i in range(p)) + sum(beta[p + i] * es[-1 - i] for i in range(q))
        v = float(np.clip(v, -10 * (np.abs(z).max() + 1), 10 * (np.abs(z).max() + 1)))
        zs.append(v)
        es.append(0.0)
        out.append(v + mean)
        psi.append(sum(beta[i] * psi[-1 - i] for i in range(min(p, len(psi)))) + (beta[p + k] if k < q else 0.0))
    w = np.array(out)
    weights = np.array(psi[:h])
    if d:
        w = (y[-1] - y[-1 - m] if seasonal else y[-1]) + np.cumsum(w)
        weights = np.cumsum(weights)
    if seasonal:
        history = list(y)
        for k in range(h):
            history.append(w[k] + history[len(y) + k - m])
        w = np.array(history[len(y) :])
    return w, sd * np.sqrt(np.cumsum(weights**2))


def fit_harmonic(y: np.ndarray, h: int, m: int, beside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ridge regression on a trend with changes of slope, sines of the season and columns beside (of the known and the coming steps)."""
    n = len(y)
    t = np.arange(n + h) / n
    cols = [np.ones(n + h), t] + [np.maximum(0, t - c) for c in np.linspace(0.1, 0.8, 8)]
    if m > 1:
        for k in range(1, min(5, m // 2) + 1):
            cols += [np.sin(2 * np.pi * k * np.arange(n + h) / m), np.cos(2 * np.pi * k * np.arange(n + h) / m)]
    if beside is not None:
        cols += [(c - c[:n].mean()) / (c[:n].std() or 1.0) for c in beside.T]
    x = np.column_stack(cols)
    penalty = np.diag([0.0, 0.0] + [1.0] * 8 + [0.1] * (x.shape[1] - 10))
    beta = np.linalg.solve(x[:n].T @ x[:n] + penalty + 1e-9 * np.eye(x.shape[1]), x[:n].T @ y)
    sd = (y - x[:n] @ beta).std()
    return x[n:] @ beta, np.full(h, sd)


#: Forecasters that read columns beside the values.
WITH_REGRESSORS = ("Harmonic",)
FITS = {"ETS": fit_ets, "Theta": fit_theta, "ARIMA": fit_arima, "Harmonic": fit_harmonic}


def forecasts(train: DataFrame, model: str, horizon: int, m: int = 1, level: float = 0.90, regressors: list[str] = (), future: DataFrame | None = None) -> DataFrame:
    """(model, fold, series, step, yhat, lo, hi, fallback) of training rows (fold, series, ds, y[, regressors]).

    future has the regressors (series, ds) of the steps after each fold's end; a forecaster that
    reads none ignores them, and a series without all of them takes its seasonal last values.
    """
    shipped(train.sparkSession)
    fit, z = FITS[model], NormalDist().inv_cdf(0.5 + level / 2)
    names = list(regressors) if model in WITH_REGRESSORS else []
    given = train.select("fold", "series", "ds", "y", *[F.col(c).cast("double").alias(c) for c in names])
    if names:
        if future is None:
            raise ValueError("regressors need their future values")
        ends = train.groupBy("fold", "series").agg(F.max("ds").alias("z"))
        ahead = future.join(ends, "series").filter(F.col("ds") > F.col("z"))
        ahead = ahead.withColumn("__k", F.row_number().over(Window.partitionBy("fold", "series").orderBy("ds"))).filter(F.col("__k") <= horizon)
        given = given.unionByName(ahead.select("fold", "series", "ds", F.lit(None).cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in names]))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ds")
        y = rows["y"].to_numpy(dtype=float)
        y = y[np.isfinite(y)] if names else y
        beside = rows[names].to_numpy(dtype=float) if names else None
        try:
            if names and (len(beside) != len(y) + horizon or not np.isfinite(beside).all()):
                raise ValueError("a regressor is not known at every step")
            means, sds = fit(y, horizon, m, beside) if names else fit(y, horizon, m)
            if not (np.isfinite(means).all() and np.isfinite(sds).all()):
                raise ValueError("not finite")
            fell = False
        except Exception:
            means, sds, fell = seasonal_last(y, horizon, m), np.full(horizon, np.nan), True
        return pd.DataFrame({
            "model": model, "fold": int(rows["fold"].iloc[0]), "series": rows["series"].iloc[0], "step": range(1, horizon + 1),
            "yhat": means, "lo": means - z * sds, "hi": means + z * sds, "fallback": fell,
        })

    return given.groupBy("fold", "series").applyInPandas(one, SCHEMA)
