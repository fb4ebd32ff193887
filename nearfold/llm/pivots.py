"""Embedding near-duplicates by a pivot-permutation index.

A bounded sample of the vectors serves as pivots.  Every vector is described by its nearest pivots, in order of cosine;
inverted lists name the vectors that have a pivot among theirs.  Two vectors are candidates if they share SHARED pivots or
more; candidates are compared by cosine in double precision.

How many nearest pivots that takes depends on the vectors: where all of them lie close together, as with a common mean,
pairs at the threshold share fewer.  So it is measured: PROBES sampled vectors get a partner each at exactly the threshold,
moved as the difference of two others points; they, and apart from them the linked pairs that there are among the sampled
ones, if PAIRS or more, must be candidates but for 1 - ENOUGH.  The first of DEPTHS at which they are is taken.

Lists go by one pivot while that keeps them short on average; beyond some LISTED vectors a list, they go by two pivots,
of which there are millions of combinations.  The candidates are the same: three shared pivots are shared pairs as well.

Equal vectors are one class with a weight.  Lists of any size are compared in blocks (see blocks.py).  In a task the
shared pivots of all its members are counted from the members' own descriptions, a pair is taken up only in the list of
its smallest shared pivot (or its two smallest), and what leaves the task is a row for each linked member: how many vectors it is linked with,
and the smallest member of its part of the task's link graph.  Pairs never leave it.

Recall at a cosine of 0.9, the hardest links, is measured against brute force in the tests; pairs of higher cosine share
more pivots.

Cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as do rows with a
null id (component null, kept), and vectors of different lengths with each other; a vector is taken whole, however long;
of pivots equally near the one with the smaller number comes first; repeated rows and ids give a row each;
labels and other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfold.llm.blocks import dealt, meet, runs
from nearfold.llm.components import components
from nearfold.llm.texts import checkpoint

THRESHOLD = 0.9
SHARED = 3
#: Nearest pivots that describe a vector, the fewest first; sampled vectors, and the recall at the threshold, to choose by.
DEPTHS, PROBES, PAIRS, ENOUGH = (12, 16, 24, 32, 48, 64, 96, 128), 1024, 30, 0.97
#: Depth beyond which lists go by one pivot in any case: the pairs would be too many.
PAIRED = 16
#: Pivots: about one for PER_PIVOT vectors, within these bounds; the largest bounds the sample and its broadcast.
PER_PIVOT, PIVOTS = 64, (64, 8192)
BLOCK = 1024
#: Vectors of a list on average, beyond which lists go by two pivots.
LISTED = 4096
_TWO = 1 << 16


def _vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, and of valid vectors: key, size, v (floats as they come, or doubles)."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("size", T.IntegerType()), T.StructField("v", T.BinaryType())])
    kind = _kind(df, vector_col)

    def run(batches):
        for b in batches:
            lists = b.column(1)
            n = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy()
            flat = pa.compute.fill_null(lists.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
            at = np.r_[0, np.cumsum(n)]
            rows = []
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                v = flat[lo:hi]
                rows.append(v.astype(kind).tobytes() if hi > lo and np.isfinite(v).all() and v.any() else None)
            keys = [r and hashlib.blake2b(r, digest_size=16).digest() for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(n, pa.int32()), pa.array(rows, pa.binary())], names=schema.names)

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col)).mapInArrow(run, schema)


def _kind(df: DataFrame, vector_col: str) -> str:
    return "<f4" if isinstance(df.schema[vector_col].dataType.elementType, T.FloatType) else "<f8"


def _matrix(rows: list[bytes], width: int, kind: str) -> np.ndarray:
    """Unit vectors in double precision; shorter ones are padded, and never compared with longer ones."""
    out = np.zeros((len(rows), width))
    step = np.dtype(kind).itemsize
    for k, r in enumerate(rows):
        out[k, : len(r) // step] = np.frombuffer(r, dtype=kind)
    out /= np.abs(out).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, k: int = DEPTHS[0]) -> np.ndarray:
    """Numbers of each vector's k nearest pivots, nearest first; ties by the number."""
    k = min(k, len(pivots))
    near = vectors @ pivots.T
    top = np.sort(np.argpartition(-near, k - 1, axis=1)[:, :k], axis=1)
    order = np.argsort(-np.take_along_axis(near, top, axis=1), axis=1, kind="stable")
    return np.take_along_axis(top, order, axis=1).astype(np.int16)


def recall_at(probes: np.ndarray, pivots: np.ndarray, depths: tuple[int, ...] = DEPTHS, seed: int = 1) -> list[float]:
    """For each depth the share of linked pairs that are candidates: of probes, unit vectors, with a partner each at a cosine
    of THRESHOLD, or of each other, whichever is less."""
    rng = np.random.default_rng(seed)
    moved = probes[rng.permutation(len(probes))] - probes[rng.permutation(len(probes))]
    moved -= (moved * probes).sum(axis=1, keepdims=True) * probes
    size = np.sqrt((moved * moved).sum(axis=1, keepdims=True))
    made = np.flatnonzero(size[:, 0] > 1e-9)
    partner = (THRESHOLD * probes + (1 - THRESHOLD**2) ** 0.5 * moved / np.maximum(size, 1e-9))[made]
    one, two = np.nonzero(np.triu(probes @ probes.T >= THRESHOLD, 1))
    deep = [nearest_pivots(x, pivots, max(depths)).astype(np.int64) for x in (probes, partner)]
    out = []
    for k in depths:
        own, other = (np.zeros((len(x), len(pivots)), dtype=bool) for x in deep)
        for mark, x in ((own, deep[0]), (other, deep[1])):
            np.put_along_axis(mark, x[:, :k], True, axis=1)
        least = min(SHARED, k, len(pivots))
        found = [1.0]
        if len(made):
            found.append(float(((own[made] & other).sum(axis=1) >= least).mean()))
        if len(one) >= PAIRS:
            shared = own.astype(np.float32) @ own.T.astype(np.float32)
            found.append(float((shared[one, two] >= least).mean()))
        out.append(min(found))
    return out


def depth_for(probes: np.ndarray, pivots: np.ndarray) -> int:
    return next((k for k, r in zip(DEPTHS, recall_at(probes, pivots), strict=True) if r >= ENOUGH), DEPTHS[-1])


def _describe(classes: DataFrame, pivots: np.ndarray, kind: str, depth: int) -> DataFrame:
    held = classes.sparkSession.sparkContext.broadcast(pivots)
    schema = T.StructType([*classes.schema.fields, T.StructField("nearest", T.BinaryType()), T.StructField("pivots", T.ArrayType(T.ShortType()))])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                own = nearest_pivots(_matrix(b.column("v").to_pylist(), held.value.shape[1], kind), held.value, depth)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in own], pa.binary()), pa.array(list(own), pa.list_(pa.int16()))], names=schema.names)

    return classes.mapInArrow(run, schema)


def links(vectors: np.ndarray, size: np.ndarray, own: np.ndarray, pivot: int, side: np.ndarray, other: int = -1) -> np.ndarray:
    """The links (members x members, symmetric) that the list of `pivot`, or of it and a larger `other`, answers for:
    candidates by shared pivots, none of which comes before these, verified by cosine.  side: block of each member; of
    two blocks, only pairs across."""
    past = max(pivot, other)
    n, k = own.shape
    shared, earlier = np.zeros((n, n), dtype=np.uint8), np.zeros((n, n), dtype=bool)
    order = np.argsort(own.ravel(), kind="stable")
    values, member = own.ravel()[order], order // k
    cut = np.flatnonzero(np.r_[True, values[1:] != values[:-1], True])
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        if b - a > 1:
            at = np.ix_(member[a:b], member[a:b])
            shared[at] += 1
            if values[a] < past and values[a] != pivot:
                earlier[at] = True
    taken = (shared >= min(SHARED, k)) & ~earlier & (size[:, None] == size[None, :])
    taken &= (side[:, None] != side[None, :]) if (side != side[0]).any() else ~np.eye(n, dtype=bool)
    if taken.any():
        taken &= vectors @ vectors.T >= THRESHOLD
    return taken


def _parts(linked: np.ndarray) -> np.ndarray:
    """Number of the smallest member of each member's part of the graph."""
    root = np.arange(len(linked))
    while True:
        low = np.minimum(root, np.where(linked, root[None, :], len(linked)).min(axis=1))
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _compare(width: int, kind: str):
    def run(batches):
        for table, cut in runs(batches, ["pivot", "lo", "hi"]):
            cols = {c: table.column(c).to_pylist() for c in ("v", "nearest")}
            pivot, lo, hi = (table.column(c).to_numpy() for c in ("pivot", "lo", "hi"))
            ids, size, weight, block = (table.column(c).to_numpy() for c in ("id", "size", "weight", "block"))
            bounds = [*cut.tolist(), len(ids)] if cut[-1] < len(ids) else cut.tolist()
            a, n, b = [], [], []
            for x, y in zip(bounds[:-1], bounds[1:], strict=True):
                side = block[x:y]
                if y - x < 2 or (lo[x] != hi[x] and (side == side[0]).all()):
                    continue
                own = np.frombuffer(b"".join(cols["nearest"][x:y]), dtype=np.int16).reshape(y - x, -1)
                one, other = divmod(int(pivot[x]), _TWO)
                linked = links(_matrix(cols["v"][x:y], width, kind), size[x:y], own, one, side, other - 1)
                hit = np.flatnonzero(linked.any(axis=1))
                if len(hit):
                    small = linked[np.ix_(hit, hit)]
                    a.append(ids[x:y][hit])
                    n.append(small.astype(np.int64) @ weight[x:y][hit])
                    b.append(ids[x:y][hit][_parts(small)])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (a, n, b)], names=["a", "n", "b"])

    return run


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """`id_col`, n_links, component_id (smallest id reachable by links), kept, for every row; ids are integers."""
    kind = _kind(df, vector_col)
    vectors = checkpoint(_vectors(df, id_col, vector_col))
    valid = vectors.where("key IS NOT NULL AND id IS NOT NULL")
    classes = valid.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.first("size").alias("size"), F.first("v").alias("v"))
    classes = checkpoint(classes)
    n, width = classes.agg(F.count("*"), F.coalesce(F.max("size"), F.lit(0))).first()
    wanted = min(PIVOTS[1], max(PIVOTS[0], n // PER_PIVOT))
    sample = classes.orderBy(F.xxhash64("key"), "key").limit(wanted + PROBES).select("v").collect()
    sampled = _matrix([r.v for r in sample], width, kind) if n else np.zeros((1, 1))
    pivots = sampled[:wanted]
    depth = depth_for(sampled[-PROBES:], pivots)
    described = _describe(classes, pivots, kind, depth)
    # the key of a list: the first pivot * _TWO, and the second pivot + 1 where there is one
    key = lambda a, b=None: a.cast("long") * _TWO + (0 if b is None else b.cast("long") + 1)
    paired = depth <= PAIRED and depth * n > LISTED * len(pivots)
    if paired:
        keys = F.flatten(F.transform("pivots", lambda a: F.transform(F.filter("pivots", lambda b: b > a), lambda b: key(a, b))))
    else:
        keys = F.transform("pivots", lambda a: key(a))
    member = described.select("id", "weight", "size", "v", "nearest", F.explode(keys).alias("pivot"))
    lists = described.select(F.explode(keys).alias("pivot")).groupBy("pivot").agg(F.count("*").alias("listed")).where("listed > 1")
    # lists by one pivot are PIVOTS[1] at most; those by two are joined by a shuffle
    member = member.join(lists if paired else F.broadcast(lists), "pivot")
    blocks = F.ceil(F.col("listed") / F.lit(BLOCK)).cast("int")
    member = member.withColumn("block", F.pmod(F.xxhash64("id", "pivot"), blocks).cast("int"))
    tasks = dealt(meet(member, "pivot", "listed", "id", BLOCK).drop("listed"), "pivot")
    found = checkpoint(tasks.mapInArrow(_compare(width, kind), "a long, n long, b long"))
    count = found.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "first")
    part = components(found.select("a", "b")).withColumnRenamed("node", "first")
    told = classes.select("key", F.col("id").alias("first"), "weight").join(count, "first", "left").join(part, "first", "left")
    told = told.select("key", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "first").alias("root"))
    held = F.when(F.col("id").isNotNull(), F.col("key"))
    out = vectors.select("id", held.alias("key")).join(told, "key", "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
