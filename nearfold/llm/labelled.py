"""A bounded sample of labelled documents for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_crc(id_col: str) -> Column:
    """crc32 of the id as text."""
    return F.crc32(F.col(id_col).cast("string"))


def sample_ids(labels: DataFrame, label_col: str, learn_from: Column, per_class: int, id_col: str = "doc_id") -> DataFrame:
    """At most `per_class` ids of each label, those with the smallest hash, from the rows where `learn_from` holds.
    Rows without id or label are left out; of repeated ids that disagree, the more frequent label counts (1 on a tie)."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & learn_from)
    one = known.groupBy(id_col).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    order = F.xxhash64(id_col)
    good, bad = (one.where(F.col("label") == v).orderBy(order, id_col).limit(per_class) for v in (1, 0))
    return good.unionByName(bad)


def sampled(docs: DataFrame, ids: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The sample's documents: id, text and label.  The sample is bounded, so its side is broadcast."""
    return docs.select(id_col, text_col).join(F.broadcast(ids), id_col)
