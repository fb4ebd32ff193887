"""One epoch of the layout as DataFrame operators.  Positions come as (id, y0, y1, ...)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfold.sources.folders import once

#: Rows of positions that may be broadcast: some 30 bytes each in two dimensions.
SMALL = 1_000_000


def coordinates(y: DataFrame) -> list[str]:
    return [c for c in y.columns if c[0] == "y" and c[1:].isdigit()]


def is_small(y: DataFrame) -> bool:
    """Whether positions may be broadcast; if not, both sides of a join with them are shuffled."""
    return y.limit(SMALL + 1).count() <= SMALL


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _ends(edges: DataFrame, y: DataFrame) -> tuple[DataFrame, list[Column], Column]:
    """Edges with both positions: the differences y_i - y_j, and q = 1 / (1 + squared distance)."""
    names = coordinates(y)
    a = y.select(F.col("id").alias("i"), *(F.col(c).alias(f"a_{c}") for c in names))
    b = y.select(F.col("id").alias("j"), *(F.col(c).alias(f"b_{c}") for c in names))
    if is_small(y):
        a, b = F.broadcast(a), F.broadcast(b)
    diff = [F.col(f"a_{c}") - F.col(f"b_{c}") for c in names]
    return edges.join(a, "i").join(b, "j"), diff, 1 / (1 + _sum([x * x for x in diff]))


def attraction(edges: DataFrame, y: DataFrame) -> DataFrame:
    """(id, f0, f1, ...): sum over the edges (i, j, p) of p q (y_i - y_j)."""
    joined, diff, q = _ends(edges, y)
    return joined.groupBy(F.col("i").alias("id")).agg(*(F.sum(F.col("p") * q * x).alias(f"f{k}") for k, x in enumerate(diff)))


def q_total(pairs: DataFrame, n: Column | int) -> DataFrame:
    """(q_total): sum of q over all ordered pairs of positions, each with itself (q = 1) among them.  pairs: their
    squared distances (i, j, d) for i < j."""
    return pairs.agg((2 * F.coalesce(F.sum(1 / (1 + F.col("d"))), F.lit(0.0)) + n).alias("q_total"))


def exact_gradient(p: DataFrame, y: DataFrame) -> DataFrame:
    """(id, g0, g1, ...): sum over all j of (p_ij - q_ij / Q) q_ij (y_i - y_j); p names every ordered pair."""
    joined, diff, q = _ends(p, y)
    sums = [F.sum(F.col("p") * q * x).alias(f"f{k}") for k, x in enumerate(diff)] + [F.sum(q * q * x).alias(f"r{k}") for k, x in enumerate(diff)]
    rows = joined.groupBy(F.col("i").alias("id")).agg(*sums, F.sum(q).alias("q"))
    return gradient(rows, len(diff))


def gradient(rows: DataFrame, dims: int, keep: Callable[[DataFrame], DataFrame] = once) -> DataFrame:
    """(id, g...) = f - r / Q of rows (id, f..., r..., q), Q being the sum of q; its one row is broadcast."""
    rows = keep(rows)  # a row for each sample, needed twice
    total = rows.agg(F.sum("q").alias("q_sum"))
    return rows.join(F.broadcast(total)).select("id", *((F.col(f"f{k}") - F.col(f"r{k}") / F.col("q_sum")).alias(f"g{k}") for k in range(dims)))


def sign(x: Column) -> Column:
    """1 for zero as well, as the gains' rule needs it."""
    return F.when(x < 0, F.lit(-1.0)).otherwise(F.lit(1.0))


def update(state: DataFrame, learning_rate: float, momentum: float, dims: int) -> DataFrame:
    """(id, y..., u..., gain...) after one step from state (id, y..., u..., gain..., g...): a gain grows by 0.2 where
    gradient and velocity differ in sign, else shrinks to 0.8 of it, to 0.01 at least; the velocity follows."""
    k = range(dims)
    gain = [F.greatest(F.when(sign(F.col(f"g{i}")) != sign(F.col(f"u{i}")), F.col(f"gain{i}") + 0.2).otherwise(F.col(f"gain{i}") * 0.8), F.lit(0.01)) for i in k]
    state = state.withColumns({f"gain{i}": gain[i] for i in k})
    state = state.withColumns({f"u{i}": momentum * F.col(f"u{i}") - learning_rate * F.col(f"gain{i}") * F.col(f"g{i}") for i in k})
    return state.select("id", *((F.col(f"y{i}") + F.col(f"u{i}")).alias(f"y{i}") for i in k), *(f"u{i}" for i in k), *(f"gain{i}" for i in k))


def zero_mean(y: DataFrame, keep: Callable[[DataFrame], DataFrame] = once) -> DataFrame:
    """The positions less their mean; other columns stay."""
    names = coordinates(y)
    y = keep(y)
    mean = y.agg(*(F.avg(c).alias(f"mean_{c}") for c in names))
    return y.join(F.broadcast(mean)).select(*((F.col(c) - F.col(f"mean_{c}")).alias(c) if c in names else c for c in y.columns))


def exaggeration(epoch: int, stop_lying_epoch: int, factor: float = 12.0) -> float:
    """Factor on P in this epoch: on to the threshold and in it."""
    return factor if epoch <= stop_lying_epoch else 1.0


def momentum(epoch: int, switch_epoch: int, first: float, final: float) -> float:
    return first if epoch <= switch_epoch else final


def schedule(epoch: Column, stop_lying_epoch: int, switch_epoch: int, first: float, final: float) -> tuple[Column, Column]:
    """exaggeration() and momentum() of a column of epochs."""
    return (F.when(epoch <= stop_lying_epoch, F.lit(12.0)).otherwise(F.lit(1.0)), F.when(epoch <= switch_epoch, F.lit(first)).otherwise(F.lit(final)))


def fresh(y: DataFrame) -> DataFrame:
    """State before the first epoch: no velocity, gains of 1."""
    k = range(len(coordinates(y)))
    return y.select("*", *(F.lit(0.0).alias(f"u{i}") for i in k), *(F.lit(1.0).alias(f"gain{i}") for i in k))
