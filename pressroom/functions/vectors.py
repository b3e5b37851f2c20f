"""Vector helpers shared by similarity jobs: which vectors are usable, and k-means codebooks of a bounded sample."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vec: str | Column) -> Column:
    """True where a vector is not NULL, holds only finite components and is not zero (or empty)."""
    v = F.col(vec) if isinstance(vec, str) else vec
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def units(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision (by their largest component first, so that no square overflows)."""
    x = rows.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of points (rows) to centres (columns)."""
    d = (points * points).sum(1)[:, None] - 2 * (points @ centres.T) + (centres * centres).sum(1)[None, :]
    return np.maximum(d, 0)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return distances(points, centres).argmin(axis=1)


def kmeans(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """``k`` centres (fewer for fewer distinct points) by Lloyd's rounds from evenly spaced points; a centre without
    points moves to the point farthest from its own centre.  The result depends on the points and their order only."""
    distinct = points[np.sort(np.unique(points, axis=0, return_index=True)[1])]
    k = max(1, min(k, len(distinct)))
    centres = distinct[np.linspace(0, len(distinct) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        d = distances(points, centres)
        own = d.argmin(axis=1)
        counts = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, weights=points[:, j], minlength=k) for j in range(points.shape[1])], axis=1)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        empty = np.flatnonzero(counts == 0)
        if len(empty):
            far = np.argsort(-d[np.arange(len(points)), own], kind="stable")[:len(empty)]
            centres[empty] = points[far]
    return centres
