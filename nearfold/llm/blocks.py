"""Comparing all members of groups of any size in tasks of bounded size.

A group of up to BLOCK members is one task.  A larger one is dealt into blocks by a hash of the member, and every two
blocks meet in a task: no task holds more than some 2 * BLOCK members, and no two members fail to meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 256


def meet(members: DataFrame, group: str, size: str, member: str, block: int = BLOCK) -> DataFrame:
    """`members` with the columns lo and hi: the tasks (group, lo, hi) in which the member takes part."""
    n = F.ceil(F.col(size) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(member, group), n).cast("int")
    other = F.explode(F.sequence(F.lit(0), n - 1))
    dealt = members.withColumn("__own", own).withColumn("__other", other)
    return dealt.select(*members.columns, F.least("__own", "__other").alias("lo"), F.greatest("__own", "__other").alias("hi"))


def dealt(tasks: DataFrame, group: str) -> DataFrame:
    return tasks.repartition(group, "lo", "hi").sortWithinPartitions(group, "lo", "hi")


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups (rows with equal keys, which stand together), with the bounds of the groups."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        cut = _bounds(held, keys)
        if len(cut) > 1:
            yield held.slice(0, int(cut[-1])), cut
            held = held.slice(int(cut[-1]))
    if held is not None and held.num_rows:
        yield held, np.array([0, held.num_rows])


def _bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(max(0, table.num_rows - 1), dtype=bool)
    for k in keys:
        v = table.column(k).to_numpy()
        new |= v[1:] != v[:-1]
    return np.r_[0, np.flatnonzero(new) + 1]


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph in which `near(i, others)` says which of `others` are linked with i."""
    left = np.arange(n)
    edges = []
    while len(left) > 1:
        queue = [int(left[0])]
        left = left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = near(i, left)
            new = left[hit].tolist()
            edges += [(i, j) for j in new]
            queue += new
            left = left[~hit]
    return edges
