"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

A pattern is a window of 13 consecutive words of a benchmark item, or a whole shorter item.  Patterns of one length
share a shift table over blocks of two words: how far the search may jump when the block stands at the end of the
window.  Cursors walk all texts of a slice in step; where the shift is zero, the block selects a bucket of patterns, and
the words themselves are compared.

The benchmark may be of any size: Spark cuts its windows and gathers the items of each, and they come in blocks of
PATTERN_BLOCK, each broadcast on its own and matched in a pass of its own over the documents.  Between passes, of which
there is one up to PATTERN_BLOCK windows, documents and hits are checkpointed: a worker holds one block's tables.

Two rules say what goes.  `contaminated` is a share: a twentieth of the document's words is hit.  drop_contaminated(), the
filter, also takes documents in which any whole window of WINDOW words occurs, however long they are: one leaked passage
is a leak.  A shorter item, which may well be a common phrase, counts by its share alone.

Cases: a null or empty text has no words; items without words or without id match nothing; repeated items, and items
that share windows, each count; a null doc_id and repeated rows give their own rows; other columns, whatever their names,
are ignored (the filter keeps them); an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfold.llm.texts import IntTable, checkpoint, give_back, sha, slices, small_batches
from nearfold.llm.wordarrays import ALNUM, Hasher, Words, joined, words_of

WINDOW = 13
#: Patterns in one broadcast block at most (each some 100 bytes).
PATTERN_BLOCK = 200_000
#: End positions that one cursor walks.
STRIDE = 512


class WuManber:
    """Search for all of a set of word patterns; `patterns`: the words joined by one space -> numbers of its items."""

    def __init__(self, patterns: dict[bytes, list[int]]):
        self.hasher = Hasher()
        by_length: dict[int, list[bytes]] = defaultdict(list)
        for p in patterns:
            by_length[p.count(b" ") + 1].append(p)
        self.groups = []
        for m, group in sorted(by_length.items()):
            size = min(2, m)
            words = words_of([p.decode("utf-8", "surrogatepass") for p in group], ALNUM, self.hasher)
            blocks = joined(words.hashes, size)
            shift: dict[int, int] = {}
            bucket: dict[int, dict[bytes, list[int]]] = defaultdict(dict)
            for k, p in enumerate(group):
                at = int(words.first[k])
                for j in range(size - 1, m):
                    block = int(blocks[at + j - size + 1])
                    shift[block] = min(shift.get(block, m), m - 1 - j)
                bucket[int(blocks[at + m - size])][p] = patterns[p]
            table = IntTable(np.array(list(shift), dtype=np.int64), np.array(list(shift.values()), dtype=np.int32))
            self.groups.append((m, size, table, dict(bucket)))

    def find(self, texts: list[str]) -> tuple[Words, list[tuple[int, int, list[int]]]]:
        """The words, and each occurrence as (its first word, words, items)."""
        words = words_of(texts, ALNUM, self.hasher)
        found = []
        counts = np.diff(words.first)
        for m, size, table, bucket in self.groups:
            blocks = joined(words.hashes, size)
            long_ = np.flatnonzero(counts >= m)
            n = -(-(counts[long_] - m + 1) // STRIDE)  # cursors of each text
            of = np.repeat(long_, n)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            p = words.first[of] + (m - 1) + nth * STRIDE
            stop = np.minimum(p + STRIDE, words.first[of + 1])
            while len(p):
                key = blocks[p - size + 1]
                jump = table.get(key)
                jump = np.where(jump < 0, m - size + 1, jump)
                for end, k in zip(p[jump == 0].tolist(), key[jump == 0].tolist(), strict=True):
                    items = bucket.get(k, {}).get(words.phrase(end - m + 1, end + 1))
                    if items:
                        found.append((end - m + 1, m, items))
                p = p + np.maximum(jump, 1)
                on = p < stop
                p, stop = p[on], stop[on]
        return words, found


def windows_of(text: str) -> list[bytes]:
    w = words_of([text], ALNUM)
    n = len(w.starts)
    return [w.phrase(i, min(n, i + WINDOW)) for i in range(max(1, n - WINDOW + 1))] if n else []


def pattern_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[dict[bytes, list[str]]]:
    """The benchmark's windows with their items, in blocks of bounded size."""

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                for item, text in zip(part.column("item").to_pylist(), part.column("text").to_pylist(), strict=True):
                    own = list(dict.fromkeys(windows_of(text)))
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array([item] * len(own), pa.string())], names=["pattern", "item"])

    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item IS NOT NULL AND text <> ''")
    patterns = small_batches(items).mapInArrow(cut, "pattern binary, item string").groupBy("pattern").agg(F.collect_set("item").alias("items"))
    block: dict[bytes, list[str]] = {}
    for r in patterns.toLocalIterator():
        block[bytes(r.pattern)] = list(r["items"])
        if len(block) >= PATTERN_BLOCK:
            yield block
            block = {}
    yield block


_FOUND = "struct<n:bigint,hits:array<int>,items:array<string>>"


def _passes(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str, item_col: str, item_text: str) -> DataFrame:
    """row (`keep` as a struct), text, found: number of words, hits (first word and length of each occurrence, flat), items."""
    spark = docs.sparkSession
    empty = F.lit(None).cast(_FOUND)
    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(text_col).alias("text"), empty.alias("found"))
    out = df.schema
    held = None
    for block in pattern_blocks(benchmark, item_col, item_text):
        if held is not None:
            df = checkpoint(df)
        held = spark.sparkContext.broadcast(block)

        def run(batches, held=held):
            search = WuManber(held.value)
            for batch in batches:
                for part in slices(batch, "text"):
                    words, found = search.find([t or "" for t in part.column("text").to_pylist()])
                    before = [x or {"hits": [], "items": []} for x in part.column("found").to_pylist()]
                    hits, items = [x["hits"] for x in before], [set(x["items"]) for x in before]
                    if found:
                        text = np.searchsorted(words.first, [f[0] for f in found], side="right") - 1
                        for k, (at, m, ids) in zip(text.tolist(), found, strict=True):
                            hits[k] += [at - int(words.first[k]), m]
                            items[k].update(ids)
                    made = pa.StructArray.from_arrays([pa.array(np.diff(words.first), pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names=["n", "hits", "items"])
                    yield pa.RecordBatch.from_arrays([part.column("row"), part.column("text"), made], names=out.names)
            give_back()

        df = small_batches(df).mapInArrow(run, out)
    return df


def covered(hits: list[int]) -> int:
    """Words inside any of the occurrences."""
    spans = sorted(zip(hits[0::2], hits[1::2], strict=True))
    total = past = 0
    for at, m in spans:
        total += max(0, at + m - max(at, past))
        past = max(past, at + m)
    return total


def is_contaminated(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def leaks(hits: list[int], n_words: int) -> bool:
    """Whether a document goes: by its share, or by any whole window."""
    return is_contaminated(covered(hits), n_words) or any(m >= WINDOW for m in hits[1::2])


_HITS = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items", T.ArrayType(T.StringType())), ("contaminated", T.BooleanType())]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", digest: bool = False
) -> DataFrame:
    """`id_col`, n_words, n_hit, n_items, items (with `digest`: items_sha256), contaminated for every document."""
    fields = [(f"{'items_sha256' if digest and n == 'items' else n}", T.StringType() if digest and n == "items" else t) for n, t in _HITS]
    out = T.StructType([T.StructField("row", T.StructType([f for f in docs.schema.fields if f.name == id_col][:1])), *(T.StructField(n, t) for n, t in fields)])
    df = _passes(docs, benchmark, [id_col], text_col, item_col, item_text).select("row", "found")

    def run(batches):
        for b in batches:
            found = b.column("found").to_pylist()
            hit = [covered(x["hits"]) for x in found]
            told = pa.array([sha(",".join(x["items"])) for x in found], pa.string()) if digest else pa.array([x["items"] for x in found], pa.list_(pa.string()))
            n = [x["n"] for x in found]
            made = [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x["items"]) for x in found], pa.int64()), told, pa.array([is_contaminated(h, k) for h, k in zip(hit, n, strict=True)], pa.bool_())]
            yield pa.RecordBatch.from_arrays([b.column("row"), *made], names=out.names)

    return df.mapInArrow(run, out).select("row.*", *(n for n, _ in fields))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that do not leak the benchmark, with all their columns."""
    df = _passes(docs, benchmark, docs.columns, text_col, item_col, item_text).select("row", "found")
    out = T.StructType(df.schema.fields[:1])

    def run(batches):
        for b in batches:
            clean = pa.array([not leaks(x["hits"], x["n"]) for x in b.column("found").to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("row").filter(clean)], names=["row"])

    return df.mapInArrow(run, out).select("row.*")
