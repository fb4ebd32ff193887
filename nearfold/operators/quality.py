"""How well positions match affinities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.operators.affinity import SMALLEST
from nearfold.operators.layout import _ends
from nearfold.sources.folders import once


def divergence(p: DataFrame, y: DataFrame, q_total: DataFrame) -> DataFrame:
    """(kl): sum over the edges (i, j, p) of p ln(p / (q / Q)), p being scaled to a sum of 1.  Edge by edge, so it holds
    for dense and for sparse affinities alike; q_total has the one row Q."""
    p = once(p)
    share = p.join(F.broadcast(p.agg(F.sum("p").alias("all")))).select("i", "j", (F.col("p") / F.col("all")).alias("p"))
    joined, _, q = _ends(share, y)
    joined = joined.join(F.broadcast(q_total))
    return joined.agg(F.sum(F.col("p") * F.ln((F.col("p") + SMALLEST) / (q / F.col("q_total") + SMALLEST))).alias("kl"))
