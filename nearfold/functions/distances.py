"""Distances: each a function of two blocks of samples, (m, D) and (n, D), to an (m, n) matrix, and a Column form."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Block = Callable[[np.ndarray, np.ndarray], np.ndarray]

#: Cells of an intermediate array at most.
_CELLS = 1 << 21
#: Share of the vectors' own squares under which a squared distance is not taken from a product of matrices.
NEAR = 1e-4


def _by_rows(a: np.ndarray, b: np.ndarray, one: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """`one` reduces differences (rows, n, D) over the last axis; differences keep duplicates at exactly 0."""
    out = np.empty((len(a), len(b)))
    step = max(1, _CELLS // max(1, b.size))
    for k in range(0, len(a), step):
        out[k : k + step] = one(a[k : k + step, None, :] - b[None, :, :])
    return out


def sqeuclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _by_rows(a, b, lambda x: np.einsum("mnd,mnd->mn", x, x))


def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(sqeuclidean(a, b))


def quick(block: Block) -> Block:
    """`block` for sums over many pairs: Euclidean distances by a product of matrices, those measured again by their
    differences that are so short beside the vectors that rounding would tell, copies among them; others as they are."""
    return {euclidean: quick_euclidean, sqeuclidean: _by_product}.get(block, block)


def quick_euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(_by_product(a, b))


def _by_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    out = (a * -2) @ b.T
    out += aa[:, None]
    out += bb
    if out.size and out.min() > NEAR * (aa.max() + bb.max()):
        return out
    for k in range(len(a)):
        near = np.flatnonzero(~(out[k] > NEAR * (aa[k] + bb)))
        if len(near):
            out[k, near] = sqeuclidean(a[k : k + 1], b[near])[0]
    return out


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _by_rows(a, b, lambda x: np.abs(x).sum(axis=2))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1))[None, :]
    return 1 - (a @ b.T) / np.where(n > 0, n, 1)


def levenshtein(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distance between strings, all of b at once."""
    codes = [np.frombuffer(str(s).encode("utf-32-le"), dtype=np.uint32) for s in b]
    size = np.array([len(c) for c in codes], dtype=np.int64)
    wide = np.full((len(b), max(1, size.max(initial=0))), 0xFFFFFFFF, dtype=np.uint32)
    for k, c in enumerate(codes):
        wide[k, : len(c)] = c
    across = np.arange(wide.shape[1] + 1)
    out = np.empty((len(a), len(b)))
    for k, s in enumerate(a):
        row = np.tile(across, (len(b), 1))
        for n, ch in enumerate(np.frombuffer(str(s).encode("utf-32-le"), dtype=np.uint32), 1):
            best = np.minimum(row[:, 1:] + 1, row[:, :-1] + (wide != ch))
            best = np.concatenate([np.full((len(b), 1), n), best], axis=1) - across
            row = np.minimum.accumulate(best, axis=1) + across
        out[k] = row[np.arange(len(b)), size]
    return out


METRICS: dict[str, Block] = {f.__name__: f for f in (euclidean, sqeuclidean, manhattan, cosine, levenshtein)}


#: Those that keep the triangle inequality.
_TRUE = {"euclidean", "manhattan", "levenshtein"}


def is_metric(metric: str | Block) -> bool:
    """Whether searches may prune by the triangle inequality.  A function of one's own says so by an attribute:
    f.is_metric = True."""
    return bool(getattr(metric, "is_metric", False)) if callable(metric) else metric in _TRUE


def each_pair(f: Callable[[object, object], float]) -> Block:
    """A distance of two samples as a distance of two blocks; a Python call for each pair, so the slow way."""
    return lambda a, b: np.array([[f(x, y) for y in b] for x in a], dtype=float).reshape(len(a), len(b))


def block_of(metric: str | Block) -> Block:
    if callable(metric):
        return metric
    if metric not in METRICS:
        raise ValueError(f"no distance named {metric}; there are {', '.join(METRICS)}")
    return METRICS[metric]


def distance_column(metric: str, a: Column, b: Column) -> Column:
    """The distance of two columns of samples, for use in a join that has its own way to choose pairs."""
    if metric == "levenshtein":
        return F.levenshtein(a, b).cast("double")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, z: s + z)
    if metric == "cosine":
        dot = lambda x, y: total(F.zip_with(x, y, lambda p, q: p * q))
        return F.lit(1.0) - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
    if metric == "manhattan":
        return total(F.zip_with(a, b, lambda p, q: F.abs(p - q)))
    square = total(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)))
    return F.sqrt(square) if metric == "euclidean" else square
