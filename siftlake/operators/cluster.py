"""Plain clustering of one small matrix, which ``ward`` does for groups of any size, and fits of a few points a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.cluster import ship


def ward_labels(x: np.ndarray, k: int) -> np.ndarray:
    """Agglomerative clustering by the least growth of within-cluster variance; labels by smallest member."""
    n = len(x)
    size = np.ones(n)
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    d[np.arange(n), np.arange(n)] = np.inf
    member = np.arange(n)
    for _ in range(n - k):
        i, j = sorted(divmod(int(d.argmin()), n))
        s = size + size[i] + size[j]
        merged = ((size + size[i]) * d[i] + (size + size[j]) * d[j] - size * d[i, j]) / s
        d[i], d[:, i] = merged, merged
        d[j], d[:, j] = np.inf, np.inf
        d[i, i] = np.inf
        size[i] += size[j]
        member[member == j] = i
    return np.unique(member, return_inverse=True)[1]


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette with Euclidean distances; a cluster of one scores 0."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    ks = np.unique(labels)
    means = np.stack([d[:, labels == k].sum(axis=1) for k in ks], axis=1)
    counts = np.array([(labels == k).sum() for k in ks])
    own = labels.searchsorted(labels) * 0 + np.searchsorted(ks, labels)
    rows = np.arange(len(x))
    a = means[rows, own] / np.maximum(counts[own] - 1, 1)
    other = means / counts
    other[rows, own] = np.inf
    b = other.min(axis=1)
    s = np.where(counts[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
    return float(s.mean())


def choose_clusters(x: np.ndarray, most: int = 6, least_size: int = 3) -> tuple[np.ndarray, float | None]:
    """The k >= 2 with the best silhouette among those whose clusters all have ``least_size`` rows; ties: fewer clusters."""
    best: tuple[np.ndarray, float | None] = (np.zeros(len(x), int), None)
    for k in range(2, min(most, len(x) - 1) + 1):
        labels = ward_labels(x, k)
        if np.bincount(labels).min() >= least_size:
            score = silhouette(x, labels)
            if best[1] is None or score > best[1] + 1e-12:
                best = labels, score
    return best


def balanced_features(*parts: np.ndarray) -> np.ndarray:
    """Columns standardised (population deviation) and each part divided by the root of its width."""
    out = []
    for p in parts:
        spread = p.std(axis=0)
        out.append((p - p.mean(axis=0)) / np.where(spread > 0, spread, 1) / np.sqrt(p.shape[1]))
    return np.concatenate(out, axis=1)


def isotonic(y: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """The closest non-decreasing sequence, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for value, weight in zip(y, np.ones(len(y)) if w is None else w):
        pools.append([float(value), float(weight), 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(n), v) for v, _, n in pools]) if pools else np.zeros(0)


def equivalent_x(x: np.ndarray, y: np.ndarray, target: float) -> tuple[float, str]:
    """Where the isotonic fit of y over x reaches ``target``: ``below``, ``above``, or ``at``; on a plateau its last x."""
    order = np.argsort(x, kind="stable")
    x, fit = np.asarray(x, float)[order], isotonic(np.asarray(y, float)[order])
    if target < fit[0]:
        return float(x[0]), "below"
    if target > fit[-1]:
        return float(x[-1]), "above"
    level = np.flatnonzero(fit <= target)[-1]
    if fit[level] == target or level + 1 == len(x):
        return float(x[level]), "at"
    share = (target - fit[level]) / (fit[level + 1] - fit[level])
    return float(x[level] + share * (x[level + 1] - x[level])), "at"


def equivalents(df: DataFrame, *, by: str, x: str, y: str, target: str) -> DataFrame:
    """``by, x, relation`` for each group's few points and its one target."""
    ship(df.sparkSession)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        at, relation = equivalent_x(rows["x"].to_numpy(), rows["y"].to_numpy(), float(rows["t"].iloc[0]))
        return pd.DataFrame([[rows["g"].iloc[0], at, relation]], columns=["g", "x", "relation"])

    rows = df.select(F.col(by).cast("string").alias("g"), *[F.col(c).cast("double").alias(a) for c, a in ((x, "x"), (y, "y"), (target, "t"))])
    return rows.groupBy("g").applyInPandas(run, "g string, x double, relation string").withColumnRenamed("g", by)
