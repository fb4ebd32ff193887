"""Shared plumbing: running a Python function over a text column in Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import re
import tempfile
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows, and bytes of text unless one text alone has more, that are worked on at once in a Python worker.  They bound
#: the worker's memory, not the result.
SLICE_ROWS, SLICE_BYTES = 512, 750_000
#: Bytes of an Arrow batch between the JVM and Python.
BATCH_BYTES = 8 << 20

#: The folding used by every operator that compares words: ASCII capitals only.  In UTF-8 no other character has them.
LOWER_AZ = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def lower_az(text: str) -> str:
    """Lower-case A-Z and nothing else."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER_AZ).decode("utf-8", "surrogatepass")


def small_batches(df: DataFrame) -> DataFrame:
    """`df`; its session then hands texts to Python in batches of BATCH_BYTES, unless it has a setting of its own."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, "67108864b") in ("67108864b", "67108864", "64m", "64MB"):
        conf.set(key, str(BATCH_BYTES))
    return df


def give_back() -> None:
    """Return what a finished task has freed to the system; an idle worker holds nothing for the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where there is no glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_texts(
    df: DataFrame,
    text_col: str,
    keep: Sequence[str],
    fields: Sequence[tuple[str, T.DataType]],
    make: Callable[[], Callable[[list[str]], Sequence]],
    keep_rows: Callable[[Sequence], np.ndarray] | None = None,
) -> DataFrame:
    """Columns `keep` of `df` and the new `fields`, computed from `text_col`; a null text counts as empty.

    `make` runs once in each task and gives a function from a list of texts to one sequence for each field.
    With `keep_rows`, which turns those sequences into a mask, only the rows where it holds are returned and the
    fields are left out: a filter that never joins back.
    """
    src = {f.name: f for f in df.schema.fields}
    out = T.StructType([src[c] for c in keep] + ([] if keep_rows else [T.StructField(n, t) for n, t in fields]))
    kinds = [to_arrow_type(t) for _, t in fields]
    cols = list(dict.fromkeys([*keep, text_col]))
    names = out.names
    alias = {c: f"_{k}" for k, c in enumerate(cols)}  # plain names on the way: a column may have any
    kept, text = [alias[c] for c in keep], alias[text_col]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, text):
                got = work([t or "" for t in part.column(text).to_pylist()])
                left = [part.column(c) for c in kept]
                if keep_rows:
                    mask = pa.array(np.asarray(keep_rows(got), dtype=bool))
                    yield pa.RecordBatch.from_arrays([c.filter(mask) for c in left], names=names)
                else:
                    made = [pa.array(v, type=k) for v, k in zip(got, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*left, *made], names=names)
        del work
        give_back()

    return small_batches(df).select(*(F.col(quoted(c)).alias(a) for c, a in alias.items())).mapInArrow(run, out)


def quoted(name: str) -> str:
    """A column's name, whatever characters it has, as select() takes it."""
    return "`" + name.replace("`", "``") + "`"


def slices(batch: pa.RecordBatch, text_col: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most SLICE_ROWS rows and SLICE_BYTES of text, or one row."""
    ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        past = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right"))
        to = max(at + 1, min(at + SLICE_ROWS, past))
        yield batch.slice(at, to - at)
        at = to


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def shared_folder(spark: SparkSession) -> None:
    """Make checkpoint() usable: the session's spark.checkpoint.dir, or, in local mode only, a folder of our own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


def checkpoint(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class IntTable:
    """Open-addressing hash table from non-negative 64-bit keys to int32, looked up for whole arrays at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, room: int = 0):
        """room: keys that there will be at most; more slow the table down."""
        self.bits = max(8, int(np.ceil(np.log2(max(1, len(keys) * 4, room * 2)))))
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, -1, dtype=np.int32)
        self.insert(keys, values)

    def insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that the table does not have."""
        keys, values = np.asarray(keys, dtype=np.int64), np.asarray(values, dtype=np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == -1
            _, first = np.unique(slot, return_index=True)
            take = first[free[first]]
            self.keys[slot[take]], self.values[slot[take]] = keys[take], values[take]
            rest = np.ones(len(keys), dtype=bool)
            rest[take] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 for keys that are absent."""
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], -1)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


class Recent(dict):
    """A bounded cache in two generations: what was used since the last turn stays, the rest goes at the next one."""

    def __init__(self, entries: int, fixed: dict | None = None):
        super().__init__(fixed or {})
        self.fixed = fixed or {}
        self.half = max(1, entries // 2)
        self.old: dict = {}

    def missing(self, wanted: set) -> list:
        """Those of `wanted` that must be made; what the older generation knows is taken over."""
        if len(self) - len(self.fixed) + len(wanted) > self.half:
            self.old = dict(self)
            self.clear()
            self.update(self.fixed)
        old, new = self.old, []
        for w in wanted:
            if w not in self:
                if w in old:
                    self[w] = old[w]
                else:
                    new.append(w)
        return new
