"""Bandwidths, conditional and joint affinities.

Conventions kept from the published code that this engine is compatible with: the kernel squares the given distance; row
sums are guarded by the smallest positive double, quotients by the machine epsilon; dense rows keep their own diagonal;
the joint of dense rows is p_ij + p_ji off the diagonal and p_ii on it; the joint of neighbour rows is (p_ij + p_ji) / 2.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearfold.functions.distances import Block, block_of
from nearfold.operators import neighbors
from nearfold.operators.neighbors import _compared
from nearfold.sources.folders import once

TOLERANCE, TRIES = 1e-5, 200
SMALLEST, EPSILON, LARGEST = 2.2250738585072014e-308, 2.220446049250313e-16, 1.7976931348623157e308
EXAGGERATION = 12.0


def search_beta(d: np.ndarray, perplexity: float, shrink: str = "halve") -> tuple[np.ndarray, ...]:
    """beta, tries, found, entropy and p of each row of distances, all rows bisected together."""
    return _search(d, perplexity, shrink)[:5]


def _search(d: np.ndarray, perplexity: float, shrink: str) -> tuple[np.ndarray, ...]:
    """search_beta(), and the beta and the sum of each row that its p is made with.

    shrink: what a beta that is too sharp from the start becomes: "halve" (the published method) or "five" (5, then 5
    times more each try, which some implementations do and which never comes back)."""
    d2 = d * d
    n = len(d)
    beta, low, high = np.ones(n), np.full(n, -np.inf), np.full(n, np.inf)
    tries, found, entropy = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=bool), np.zeros(n)
    total, used = np.ones(n), np.ones(n)
    target = np.log(perplexity)
    for _ in range(TRIES):
        on = np.flatnonzero(~found)
        if not len(on):
            break
        b = beta[on]
        square = d2 if len(on) == n else d2[on]
        own = square * -b[:, None]
        np.exp(own, out=own)
        s = own.sum(axis=1) + SMALLEST
        h = b * np.einsum("nd,nd->n", own, square) / s + np.log(s)
        total[on], entropy[on], used[on] = s, h, b
        tries[on] += 1
        diff = h - target
        done = np.abs(diff) < TOLERANCE
        found[on[done]] = True
        up, down = on[~done & (diff > 0)], on[~done & ~(diff > 0)]
        low[up] = beta[up]
        beta[up] = np.where(np.isinf(high[up]), beta[up] * 2, (beta[up] + high[up]) / 2)
        high[down] = beta[down]
        if shrink == "halve":
            less = beta[down] / 2
        else:
            less = np.where(beta[down] < 0, beta[down] * 2, np.where(beta[down] <= 1, 5.0, beta[down] * 5))
        with np.errstate(invalid="ignore"):
            beta[down] = np.where(np.isinf(low[down]), less, (beta[down] + low[down]) / 2)
        beta = np.clip(beta, -LARGEST, LARGEST)
    p = d2 * -used[:, None]
    np.exp(p, out=p)
    p /= (total + EPSILON)[:, None]
    return beta, tries, found, entropy, p, used, total


_ROW = "i long, beta double, tries int, found boolean, entropy double, j array<long>, p array<double>"


def bandwidths(near: DataFrame, perplexity: float, shrink: str = "halve") -> DataFrame:
    """(i, beta, tries, found, entropy, j, p) of every row of neighbours (i, j, d); a row has a bounded number of them."""
    rows = near.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("d", "j"))).alias("near"))
    names = [c.split()[0] for c in _ROW.split(", ")]

    def run(batches):
        for b in batches:
            near_ = b.column("near")
            flat = near_.flatten()
            size = np.asarray(near_.value_lengths())
            d, j = flat.field("d").to_numpy(), flat.field("j").to_numpy()
            at = np.r_[0, np.cumsum(size)]
            order = np.argsort(size, kind="stable")
            out = {}
            for n in np.unique(size):  # rows of one length together
                own = order[size[order] == n]
                m = at[own][:, None] + np.arange(n)
                got = search_beta(d[m], perplexity, shrink)
                out |= {int(r): (x[0], x[1], x[2], x[3], j[m[k]], x[4]) for k, (r, x) in enumerate(zip(own, zip(*got, strict=True), strict=True))}
            cols = list(zip(*(out[r] for r in range(len(size))), strict=True)) if out else [[]] * 6
            kinds = [pa.float64(), pa.int32(), pa.bool_(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([b.column("i"), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], names=names)

    return rows.mapInArrow(run, _ROW)


def conditional(rows: DataFrame) -> DataFrame:
    """(i, j, p) of bandwidths()."""
    return rows.select("i", F.explode(F.arrays_zip("j", "p")).alias("x")).select("i", "x.j", "x.p")


def symmetric(p: DataFrame) -> DataFrame:
    """(i, j, p): (p_ij + p_ji) / 2, with 0 for an edge that one side lacks; one shuffle, no join."""
    half = p.select("i", "j", (F.col("p") / 2).alias("p"))
    return half.unionByName(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "p")).groupBy("i", "j").agg(F.sum("p").alias("p"))


def normalized(p: DataFrame, exaggeration: float = EXAGGERATION) -> DataFrame:
    """p times the exaggeration over the sum of all; the one row of the sum is broadcast.  p, needed twice, is computed
    once."""
    p = once(p)
    total = p.agg(F.sum("p").alias("total"))
    return p.join(F.broadcast(total)).select("i", "j", (exaggeration * F.col("p") / (F.col("total") + EPSILON)).alias("p"))


def degrees(p: DataFrame) -> DataFrame:
    return p.groupBy("i").agg(F.count("*").alias("degree"))


def row_offsets(p: DataFrame, buckets: int = 64) -> DataFrame:
    """(i, row_offset): edges in the rows before row i.  Offsets within ranges of ids, then those of whole ranges, of
    which there are `buckets`: no task orders all rows."""
    deg = once(degrees(p))  # a row for each sample, needed three times
    low, high = deg.agg(F.min("i"), F.max("i")).first()
    width = max(1, ((high or 0) - (low or 0)) // buckets + 1)
    deg = deg.withColumn("range", F.floor((F.col("i") - F.lit(low or 0)) / width))
    before = W.rowsBetween(W.unboundedPreceding, -1)
    whole = deg.groupBy("range").agg(F.sum("degree").alias("n"))
    whole = whole.select("range", F.coalesce(F.sum("n").over(before.orderBy("range")), F.lit(0)).alias("start"))
    own = F.coalesce(F.sum("degree").over(before.partitionBy("range").orderBy("i")), F.lit(0))
    return deg.withColumn("own", own).join(F.broadcast(whole), "range").select("i", (F.col("start") + F.col("own")).cast("long").alias("row_offset"))


def dense_rows(points: DataFrame, perplexity: float, metric: str | Block = "euclidean", shrink: str = "halve", include_self: bool = True) -> DataFrame:
    """(i, j, p): conditional affinities of every sample to all, itself among them (p_ii from distance 0) unless told
    otherwise.  A task holds a few rows of the matrix; the whole of it is the result."""
    block = block_of(metric)

    def distances(ids, values, others, all_values):
        d = block(values, all_values)
        d[ids[:, None] == others[None, :]] = 0 if include_self else 1e150
        return d

    if neighbors._weight(points)[1] <= neighbors.BROADCAST_BYTES:

        def one(ids, values, others, all_values):
            p = search_beta(distances(ids, values, others, all_values), perplexity, shrink)[4]
            return np.repeat(ids, len(others)), np.tile(others, len(ids)), p.ravel()

        return _compared(points, one, "i long, j long, p double")

    def some(ids, values, others, all_values):
        d = distances(ids, values, others, all_values)
        return ids, [others] * len(ids), list(d)

    rows = _compared(points, some, "i long, j array<long>, d array<double>").groupBy("i").agg(F.flatten(F.collect_list("j")).alias("j"), F.flatten(F.collect_list("d")).alias("d"))

    def run(batches):
        for b in batches:
            for at in range(b.num_rows):
                j, d = (b.column(c).slice(at, 1).flatten().to_numpy() for c in ("j", "d"))
                order = np.argsort(j)
                p = search_beta(d[order][None, :], perplexity, shrink)[4][0]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("i")[at].as_py(), len(j))), pa.array(j[order]), pa.array(p)], names=["i", "j", "p"])

    return rows.mapInArrow(run, "i long, j long, p double")


def dense_joint(p: DataFrame) -> DataFrame:
    """(i, j, p): p_ij + p_ji off the diagonal, p_ii on it."""
    off = p.where("i <> j")
    both = off.unionByName(off.select(F.col("j").alias("i"), F.col("i").alias("j"), "p")).groupBy("i", "j").agg(F.sum("p").alias("p"))
    return both.unionByName(p.where("i = j"))
