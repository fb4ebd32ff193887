"""Near-duplicate documents by min-max hashing.

A document's set holds its distinct shingles of `width` words.  Each of PERMUTATIONS hash functions gives two signature values,
the smallest and the largest hash of the set: both agree between two sets with probability equal to their similarity,
so half the hash evaluations give as long a signature, of lower variance.  Documents with the same set form a class,
and one row stands for it.  ROWS values make a band; classes that agree in a band share a bucket.

Buckets of any size are compared in blocks (see blocks.py): within a block a spanning forest of the pairs whose
signatures agree in SIGNAL of all values is kept, never all pairs.  The components of that forest are clusters; within
the blocks of a cluster every pair is compared on its full sets, again keeping a spanning forest of those with
100 * intersection >= 80 * union.  The components of these are the result.

A pair at exactly the threshold misses every bucket with probability (1 - 0.8**5)**24, 7e-5, and the signature filter
with some 2e-5.  Signatures and set keys come from 63-bit fingerprints of shingles; links are confirmed on the shingles
themselves, numbered exactly.

Cases: null or empty texts, or texts without words, have an empty set and link with nothing, as do rows with a null id
(component null, kept); with fewer than `width` words the whole sequence is the one shingle; repeated rows and ids give a row
each, by their own text: classes are named by their set, never by an id; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfold.llm.blocks import dealt, forest, meet, runs
from nearfold.llm.components import components
from nearfold.llm.texts import SLICE_BYTES, checkpoint, give_back, map_texts, quoted
from nearfold.llm.wordarrays import BLANK, Hasher, joined, mix, words_of

#: Words of a shingle in the query; the pipeline has its own.
SHINGLE, NUMERATOR, DENOMINATOR = 4, 80, 100
PERMUTATIONS, ROWS = 60, 5
VALUES = 2 * PERMUTATIONS
BANDS = VALUES // ROWS
#: Share of signature bytes that must agree; four standard deviations under the threshold.
SIGNAL = 0.65
#: Rows of a side that may be broadcast (some 40 bytes each); a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000

_rng = np.random.default_rng(20)
_MUL = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64)


def shingle_sets(texts: list[str], hasher: Hasher, width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct fingerprints of each text's shingles."""
    w = words_of(texts, BLANK, hasher)
    runs_ = joined(w.hashes, width)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(runs_[a : b - width + 1]))
        else:
            out.append(mix(joined(w.hashes[a:b], b - a).astype(np.uint64) + np.uint64(b - a)) if b > a else np.zeros(0, dtype=np.int64))
    return out


def set_key(fingerprints: np.ndarray) -> bytes:
    return hashlib.blake2b(fingerprints.tobytes(), digest_size=16).digest()


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Sets x VALUES: minima, then maxima, of every hash function; all sets have members."""
    flat = np.concatenate(sets).astype(np.uint64)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), VALUES), dtype=np.uint64)
    for k in range(PERMUTATIONS):
        h = flat * _MUL[k] + _ADD[k]
        out[:, k] = np.minimum.reduceat(h, starts)
        out[:, PERMUTATIONS + k] = np.maximum.reduceat(h, starts)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """Sets x BANDS; the values of a band come from different hash functions."""
    rows = values.reshape(len(values), ROWS, BANDS)  # value j + r * BANDS is row r of band j
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(values), BANDS)).copy()
    for r in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, r]).astype(np.uint64)
    return h.astype(np.int64)


def sign(docs: DataFrame, id_col: str, text_col: str, width: int = SHINGLE) -> DataFrame:
    """id, n_shingles, and of non-empty sets the key, one byte of each signature value, and the band keys."""

    def make():
        hasher = Hasher()

        def work(texts: list[str]):
            sets = shingle_sets(texts, hasher, width)
            full = [i for i, s in enumerate(sets) if len(s)]
            keys, bytes_, bands = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            if full:
                values = signatures([sets[i] for i in full])
                small = (mix(values) & 255).astype(np.uint8)
                for row, i in enumerate(full):
                    keys[i], bytes_[i] = set_key(sets[i]), small[row].tobytes()
                for i, b in zip(full, band_keys(values), strict=True):
                    bands[i] = b
            return [len(s) for s in sets], keys, bytes_, bands

        return work

    fields = [("n_shingles", T.LongType()), ("key", T.BinaryType()), ("signature", T.BinaryType()), ("bands", T.ArrayType(T.LongType()))]
    return map_texts(docs, text_col, [id_col], fields, make).withColumnRenamed(id_col, "id")


def _alike(batches):
    """A spanning forest, in every block of a bucket, of the members whose signatures agree enough."""
    least = SIGNAL * VALUES
    for table, cut in runs(batches, ["bucket", "lo", "hi"]):
        ids = table.column("node").to_numpy()
        sig = np.frombuffer(b"".join(table.column("signature").to_pylist()), dtype=np.uint8).reshape(-1, VALUES)
        size = np.diff(np.r_[cut, len(ids)]) if cut[-1] < len(ids) else np.diff(cut)
        begins = cut[: len(size)]
        two = begins[size == 2]
        hit = two[(sig[two] == sig[two + 1]).sum(axis=1) >= least]
        a, b = [ids[hit]], [ids[hit + 1]]
        for at, n in zip(begins[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            own = sig[at : at + n]
            edges = np.array(forest(n, lambda i, rest, own=own: (own[rest] == own[i]).sum(axis=1) >= least), dtype=np.int64).reshape(-1, 2)
            a.append(ids[at + edges[:, 0]])
            b.append(ids[at + edges[:, 1]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
    give_back()


def linked(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets that reach the threshold."""
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if DENOMINATOR * both >= NUMERATOR * (len(sets[0]) + len(sets[1]) - both) else []
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, term = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(term, kind="stable")
    posting, begin = owner[order], np.r_[0, np.cumsum(np.bincount(term))]
    bounds = np.r_[0, np.cumsum(size)]

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        t = term[bounds[i] : bounds[i + 1]]
        a, n = begin[t], begin[t + 1] - begin[t]
        at = np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        both = np.bincount(posting[at], minlength=len(sets))[rest]
        return DENOMINATOR * both >= NUMERATOR * (size[i] + size[rest] - both)

    return forest(len(sets), near)


class Numbers:
    """Shingles as exact numbers, the same for the same words within one object; nothing is hashed."""

    def __init__(self):
        self.words: dict[bytes, int] = {}
        self.short: dict[bytes, int] = {}

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """The words of each text."""
        data = [t.encode("utf-8", "surrogatepass").translate(BLANK).split() for t in texts]
        names = self.words
        return [np.array([names.setdefault(x, len(names)) for x in words], dtype=np.int64) for words in data]

    def sets(self, words: list[np.ndarray], width: int) -> list[np.ndarray]:
        """The distinct shingles of each text; fewer than `width` words are one of their own, with a negative number."""
        flat = np.concatenate([*words, np.zeros(0, np.int64)])
        code = flat
        for k in range(1, width):
            left, right = code[: max(0, len(flat) - k)], flat[k:]
            code = np.unique(left * (len(self.words) + 1) + right, return_inverse=True)[1]
        first = np.r_[0, np.cumsum([len(w) for w in words])].tolist()
        return [np.unique(code[a : b - width + 1]) if b - a >= width else np.array([-1 - self.short.setdefault(flat[a:b].tobytes(), len(self.short))]) for a, b in zip(first[:-1], first[1:], strict=True)]


def _verified(batches, width: int):
    """A spanning forest, in every block of a cluster, of the members whose full sets are similar enough.  A row whose
    set is not that of its class, which another text with the same id can be, takes no part."""
    hasher = Hasher()
    for table, cut in runs(batches, ["cluster", "lo", "hi"]):
        texts = table.column("text")
        length = np.cumsum(pa.compute.binary_length(texts).to_numpy())
        keys, numbers = table.column("key").to_pylist(), Numbers()
        own: list[bool] = []
        words: list[np.ndarray] = []
        at = 0
        while at < len(length):
            to = max(at + 1, int(np.searchsorted(length, (length[at - 1] if at else 0) + SLICE_BYTES, side="right")))
            some = texts.slice(at, to - at).to_pylist()
            own += [set_key(s) == k for s, k in zip(shingle_sets(some, hasher, width), keys[at:to], strict=True)]
            words += numbers.of(some)
            at = to
        sets = numbers.sets(words, width)
        nodes = table.column("node").to_pylist()
        a, b = [], []
        bounds = [*cut.tolist(), len(nodes)] if cut[-1] < len(nodes) else cut.tolist()
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            members = {nodes[k]: sets[k] for k in range(lo, hi) if own[k]}
            if len(members) > 1:
                names = list(members)
                for i, j in linked(list(members.values())):
                    a.append(names[i])
                    b.append(names[j])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    give_back()


def _bounded(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it is known to be small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _classes(docs: DataFrame, id_col: str, text_col: str, width: int) -> tuple[DataFrame, DataFrame]:
    """Signed rows (id, n_shingles, key, ...), and classes (key, id, component_id, first): the documents with the same set,
    named by the set, their smallest id, the smallest id of their component, and whether they are the component's first
    class, by id and set."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = checkpoint(sign(docs, "id", "text", width))
    has_set = signed.where("key IS NOT NULL AND id IS NOT NULL")
    classes = has_set.groupBy("key").agg(F.min("id").alias("id"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    classes = checkpoint(classes.withColumn("node", F.monotonically_increasing_id()))
    places = classes.select("node", F.explode("bands").alias("bucket"))
    sizes = places.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = places.join(sizes, "bucket").join(classes.select("node", "signature"), "node")
    alike = dealt(meet(shared, "bucket", "size", "node").select("bucket", "lo", "hi", "node", "signature"), "bucket")
    cluster = components(alike.mapInArrow(_alike, "a long, b long"))
    whole = cluster.select("node", F.col("component").alias("cluster"))
    whole = whole.unionByName(whole.select(F.col("cluster").alias("node"), "cluster").distinct())
    counts = whole.groupBy("cluster").agg(F.count("*").alias("size"))
    members = checkpoint(whole.join(counts, "cluster").join(classes.select("node", "id", "key"), "node"))
    rows = docs.where("text IS NOT NULL").join(_bounded(members), "id")
    tasks = dealt(meet(rows, "cluster", "size", "node").select("cluster", "lo", "hi", "node", "key", "text"), "cluster")
    found = components(tasks.mapInArrow(lambda batches: _verified(batches, width), "a long, b long"))
    root = classes.select("key", "id", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # members of components of several classes: as many rows as `found` has, and their roots
    several = root.join(_bounded(found.select("component").distinct()), "component")
    least = several.groupBy("component").agg(F.min(F.struct("id", "key")).alias("least"))
    root = root.join(_bounded(least), "component", "left")
    return signed, root.select("key", "id", F.coalesce("least.id", "id").alias("component_id"), F.coalesce(F.col("least.key") == F.col("key"), F.lit(True)).alias("first"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """`id_col`, n_shingles, component_id (smallest id reachable by links), kept, for every row; ids are integers."""
    signed, classes = _classes(docs, id_col, text_col, width)
    named = F.col("key").isNotNull() & F.col("id").isNotNull()
    linked_ = signed.where(named).select("id", "n_shingles", "key").join(classes.select("key", "component_id"), "key")
    # rows without a set or an id never meet in a join: they may be any share of all rows
    alone = signed.where(~named).select("id", "n_shingles", F.col("id").alias("component_id"))
    out = linked_.select("id", "n_shingles", "component_id").unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """One document of each group of near copies, with all its columns: that with the smallest id, of different texts
    with that id the one whose set comes first, of rows with the same id and set the first by all their columns.  Rows
    without a set, and rows with a null id, all stay."""
    signed, classes = _classes(docs, id_col, text_col, width)
    named = F.col("key").isNotNull() & F.col("id").isNotNull()
    told = signed.where(named).select("id", "key").join(classes.select("key", F.col("id").alias("least"), "first"), "key")
    gone = checkpoint(told.select("id", "key", (F.col("first") & (F.col("id") == F.col("least"))).alias("stays")))
    if gone.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return docs.join(_bounded(gone.where("NOT stays").select(F.col("id").alias(id_col))), id_col, "left_anti").select(*map(quoted, docs.columns))

    # the same id more than once: rows are told apart by their set
    def make():
        hasher = Hasher()
        return lambda texts: [[set_key(s) if len(s) else None for s in shingle_sets(texts, hasher, width)]]

    row = F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row")
    keyed = map_texts(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), row), "text", ["id", "row"], [("key", T.BinaryType())], make)
    stays = gone.where("stays").select("id", "key").distinct()
    one = keyed.where(named).join(_bounded(stays), ["id", "key"]).groupBy("id", "key").agg(F.min("row").alias("row"))
    return one.select("row.*").unionByName(keyed.where(~named).select("row.*"))
