"""Token counts by a map-side two-tier lookup.

Pre-tokens are the units between spaces, tabs and line ends.  Tier one is a broadcast hash table of flat arrays, from the
fingerprints of frequent ones to their token counts; tier two is such a table in each Python worker, filled by encoding
the units that neither knows.  All units of a slice of texts are looked up at once, and no pre-token is ever shuffled: for
tier one the tasks send the driver what they tallied over a sample of some TABLE_DOCUMENTS documents.  Both tables are
only caches, so no result depends on the sample.

Units can be counted on their own because the tokenizer's pattern never spans white space and Unicode composition never
crosses it.  They are told apart by 63-bit fingerprints, which different units share with a chance of 1e-19 a pair.

Cases: a null or empty text has 0 bytes and 0 tokens; a null id, repeated ids and repeated rows each give their own
row; other columns of the input are ignored whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfold.llm.texts import IntTable, map_texts
from nearfold.llm.wordarrays import Hasher, words_of

#: Documents, about, whose pre-tokens fill the broadcast table.
TABLE_DOCUMENTS = 2_000
#: Entries of the broadcast table, and of each worker's table, at most; units of more than UNIT_BYTES are in neither.
TABLE_ENTRIES, CACHE_ENTRIES, UNIT_BYTES = 50_000, 500_000, 256

#: Units end at these four; other white space stays inside them.
UNITS = bytes(32 if c in b" \t\n\r" else c for c in range(256))


class UnitCounter:
    """Counts tokens of texts with the library's tokenizer, asking it for unknown units only.
    frequent: fingerprints and token counts."""

    def __init__(self, path: str, frequent: tuple[np.ndarray, np.ndarray] | None = None, entries: int = CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.hasher, self.entries = Hasher(), entries
        self.frequent = IntTable(*(frequent or (np.zeros(0), np.zeros(0))))
        self._clear()

    def _clear(self) -> None:
        self.known, self.used = IntTable(np.zeros(0), np.zeros(0), self.entries), 0

    def lengths(self, new: list[str]) -> np.ndarray:
        """Tokens of each unit: the units are given as pre-split words, a token then names its unit."""
        of = self.tokenizer.encode(new, is_pretokenized=True, add_special_tokens=False).word_ids if new else []
        return np.bincount(np.array(of, dtype=np.int64), minlength=len(new)).astype(np.int32)

    def count(self, texts: list[str]) -> list[int]:
        w = words_of(texts, UNITS, self.hasher)
        n = self.frequent.get(w.hashes)
        miss = np.flatnonzero(n < 0)
        n[miss] = self.known.get(w.hashes[miss])
        miss = miss[n[miss] < 0]
        if len(miss):
            new, at = np.unique(w.hashes[miss], return_index=True)
            at = miss[at]
            made = self.lengths([w.data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(w.starts[at].tolist(), w.ends[at].tolist(), strict=True)])
            n[miss] = made[np.searchsorted(new, w.hashes[miss])]
            kept = w.ends[at] - w.starts[at] <= UNIT_BYTES
            if self.used + kept.sum() > self.entries:
                self._clear()
            if kept.sum() <= self.entries:
                self.known.insert(new[kept], made[kept])
                self.used += int(kept.sum())
        return np.diff(np.r_[0, np.cumsum(n, dtype=np.int64)][w.first]).tolist()


def frequent_units(docs: DataFrame, text_col: str) -> list[str]:
    """Frequent pre-tokens of a sample of about TABLE_DOCUMENTS rows; each task sends its own tally."""
    total = docs.count()
    if not total:
        return []
    part = min(1.0, TABLE_DOCUMENTS / total)
    chance = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20))

    def tops(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(u for u in (t or "").encode("utf-8", "surrogatepass").translate(UNITS).split(b" ") if 0 < len(u) <= UNIT_BYTES)
            if len(seen) > 4 * TABLE_ENTRIES:
                seen = Counter(dict(seen.most_common(TABLE_ENTRIES)))
        top = [x for x in seen.most_common(TABLE_ENTRIES) if x[1] > 1]
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], names=["unit", "n"])

    got = docs.where(chance < int(part * (1 << 20)) + 1).select(text_col).mapInArrow(tops, "unit binary, n bigint").toArrow()
    seen: Counter[bytes] = Counter()
    for u, n in zip(got.column("unit").to_pylist(), got.column("n").to_pylist(), strict=True):
        seen[u] += n
    return [u.decode("utf-8", "surrogatepass") for u, _ in seen.most_common(TABLE_ENTRIES)]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """`id_col`, n_bytes, n_tokens, over_limit (more than `limit` tokens) for every row; `path`: a tokenizers .json."""
    frequent = frequent_units(docs, text_col)
    own = UnitCounter(path)
    keys = words_of([" ".join(frequent)], UNITS, own.hasher).hashes
    held = docs.sparkSession.sparkContext.broadcast((keys, own.lengths(frequent)))

    def make():
        counter = UnitCounter(path, held.value)

        def work(texts: list[str]) -> tuple[list, ...]:
            n = counter.count(texts)
            return [len(t.encode()) for t in texts], n, [x > limit for x in n]

        return work

    fields = [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())]
    return map_texts(docs, text_col, [id_col], fields, make)
