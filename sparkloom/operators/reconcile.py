"""Hierarchical reconciliation: y~ = S P y, with P from the summing matrix and a weighting."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METHODS = ("bottom_up", "ols", "wls_struct", "mint_shrink")


def summing(edges: list[tuple[str, str]], series: list[str]) -> tuple[list[str], np.ndarray]:
    """(leaves, S): S[i, j] is 1 where leaf j is at or below series i. Series outside the hierarchy are leaves."""
    children: dict[str, list[str]] = {}
    for parent, child in edges:
        children.setdefault(parent, []).append(child)
    leaves = [s for s in series if s not in children]
    place = {s: j for j, s in enumerate(leaves)}

    def below(s: str, path: tuple[str, ...] = ()) -> set[int]:
        if s in path:
            raise ValueError(f"{s} is above itself")
        return {place[s]} if s in place else set().union(*(below(c, (*path, s)) for c in children[s]))

    matrix = np.zeros((len(series), len(leaves)))
    for i, s in enumerate(series):
        matrix[i, sorted(below(s))] = 1.0
    return leaves, matrix


def shrunk(errors: np.ndarray) -> np.ndarray:
    """Covariance of errors (observations x series): correlations scaled down by how uncertain they are, between the series' own deviations.

    A correlation is a mean of products of standardised errors, so its uncertainty is their
    variance over their number; the correlations keep 1 less the ratio of what is uncertain to
    what there is, over all pairs. Under three observations there are deviations alone.
    """
    n, k = errors.shape
    floor = 1e-8 * np.eye(k)
    if n < 3:
        return floor + np.diag(errors.var(axis=0) if n else np.ones(k))
    unit = (errors - errors.mean(axis=0)) / (errors.std(axis=0) + 1e-12)
    products = np.einsum("ti,tj->tij", unit, unit)
    correlation, doubt = products.mean(axis=0), products.var(axis=0) / n
    for x in (correlation, doubt):
        np.fill_diagonal(x, 0.0)
    there = np.square(correlation).sum()
    keep = max(0.0, 1.0 - doubt.sum() / there) if there else 0.0
    deviation = errors.std(axis=0, ddof=1)
    return floor + np.outer(deviation, deviation) * (np.eye(k) + keep * correlation)


def deviations(matrix: np.ndarray, method: str, errors: np.ndarray | None) -> np.ndarray:
    """A factor of the errors' covariance that a method assumes: equal, as many as a series has leaves, or as past errors have it."""
    if method == "mint_shrink":
        if errors is None:
            raise ValueError("mint_shrink needs errors of past folds")
        return np.linalg.cholesky(shrunk(errors))
    variances = {"ols": np.ones(len(matrix)), "wls_struct": matrix.sum(axis=1)}
    if method not in variances:
        raise ValueError(f"no method {method}; there are {', '.join(METHODS)}")
    return np.diag(np.sqrt(variances[method]))


def projection(matrix: np.ndarray, leaves: list[str], series: list[str], method: str, errors: np.ndarray | None = None) -> np.ndarray:
    """What reconciled values are made of, series by series.

    Leaves are the least squares fit to all series once these are brought to equal, independent
    errors; bottom_up takes the leaves as they are.
    """
    if method == "bottom_up":
        return matrix @ np.array([[float(s == leaf) for s in series] for leaf in leaves])
    whitened = np.linalg.solve(deviations(matrix, method, errors), np.hstack([matrix, np.eye(len(matrix))]))
    fit, *_ = np.linalg.lstsq(whitened[:, : len(leaves)], whitened[:, len(leaves) :], rcond=None)
    return matrix @ fit


def applied(predictions: DataFrame, weights: np.ndarray, series: list[str]) -> DataFrame:
    """predictions (keys, series, yhat[, lo, hi]) reconciled: a sparse table of weights is joined, bounds move by the same amount."""
    spark = predictions.sparkSession
    cells = [(series[i], series[j], float(weights[i, j])) for i, j in zip(*np.nonzero(np.abs(weights) > 1e-15))]
    table = spark.createDataFrame(cells, "node string, series string, w double")
    keys = [c for c in predictions.columns if c not in ("series", "yhat", "lo", "hi")]
    new = predictions.join(table, "series").groupBy(*keys, "node").agg(F.sum(F.col("w") * F.col("yhat")).alias("__new"))
    both = predictions.join(new.withColumnRenamed("node", "series"), [*keys, "series"])
    shift = F.col("__new") - F.col("yhat")
    bounds = [(F.col(c) + shift).alias(c) for c in ("lo", "hi") if c in predictions.columns]
    return both.select(*keys, "series", F.col("__new").alias("yhat"), *bounds)


def coherency_gap(predictions: DataFrame, edges: DataFrame) -> DataFrame:
    """(parent, gap): mean |sum of children - parent| over mean |parent|."""
    keys = [c for c in predictions.columns if c not in ("series", "yhat", "lo", "hi")]
    sums = predictions.join(edges, predictions.series == edges.child).groupBy("parent", *keys).agg(F.sum("yhat").alias("s"))
    both = sums.join(predictions.withColumnRenamed("series", "parent"), ["parent", *keys])
    return both.groupBy("parent").agg((F.avg(F.abs(F.col("s") - F.col("yhat"))) / (F.avg(F.abs("yhat")) + 1e-12)).alias("gap"))


def error_matrix(errors: DataFrame, series: list[str]) -> np.ndarray:
    """(fold, series, step, error) as a matrix of (fold, step) rows; a missing one is the series' mean error of the fold."""
    rows = errors.groupBy("fold", "step").pivot("series", series).agg(F.first("error")).orderBy("fold", "step").collect()
    x = np.array([[np.nan if r[s] is None else r[s] for s in series] for r in rows], dtype=float).reshape(-1, len(series))
    fold = np.array([r["fold"] for r in rows])
    for f in np.unique(fold):
        part = x[fold == f]
        mean = np.nan_to_num(np.nanmean(np.where(np.isnan(part).all(axis=0), 0.0, part), axis=0))
        x[fold == f] = np.where(np.isnan(part), mean, part)
    return x
