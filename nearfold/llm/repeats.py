"""Periodic runs of words, by the runs theorem.

A text's words are numbered, and its suffixes sorted by doubling: in every round the suffixes that are still tied are
ordered by the ranks of what follows them, until no two are.  The root of every run, a Lyndon word under the order of
words or under its reverse, is the longest Lyndon word at its place, and that ends where the ranks of the suffixes (the
inverse suffix array) next become smaller, or under the reverse order greater.  So there are at most two candidates a
place.  Each is carried on in both directions as far as its period holds: that is the longest common prefix of two
suffixes of the text, or of the text read backwards, which is the least of a range of the array of neighbouring common
prefixes, looked up in a sparse table.

All texts of a slice are worked on at once: words are numbered for each text by itself and each text ends in a symbol of
its own, so no suffix is compared with one of another text.  Work is n log n in the words of a text, whatever it repeats.

Cases: a null or empty text, or one of white space, has no words and no runs; a text is taken whole, however long, and
needs some 40 bytes a word for each doubling of its length while it is at work; runs of equal length are ordered by
start, then period; repeated rows and rows with a null id give a row each; other columns are ignored, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfold.llm.texts import map_texts, quoted

#: A run has this many words, and this many periods, at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Neighbours that are looked at one by one before the sparse table is asked.
NEAR = 4


def suffix_ranks(symbols: np.ndarray) -> list[np.ndarray]:
    """Ranks of the suffixes by their first 1, 2, 4, ... symbols; the last are all different.  Every text of the array
    ends in a symbol that stands nowhere else."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    new = np.r_[True, symbols[order[1:]] != symbols[order[:-1]]]
    rank = np.empty(n, dtype=np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, h = [rank], 1
    tied = order[~(new & np.r_[new[1:], True])]
    while len(tied):
        key = rank[tied].astype(np.int64) * n + rank[tied + h]
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        own, at = rank[tied], np.arange(len(tied))
        group = np.r_[True, own[1:] != own[:-1]]
        new = np.r_[True, key[1:] != key[:-1]]
        later = np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        rank = rank.copy()
        rank[tied] = own + later
        levels.append(rank)
        tied = tied[~(new & np.r_[new[1:], True])]
        h *= 2
    return levels


def common_prefixes(levels: list[np.ndarray]) -> np.ndarray:
    """Entry r: symbols that the suffixes of rank r - 1 and r have in common; entry 0 is 0."""
    rank, first = levels[-1], levels[0]
    place = np.empty(len(rank), dtype=np.int32)
    place[rank] = np.arange(len(rank), dtype=np.int32)
    at = np.flatnonzero(first[place[1:]] == first[place[:-1]])
    a, b = place[at], place[at + 1]
    lcp = np.zeros(len(rank), dtype=np.int32)
    for k in range(len(levels) - 1, -1, -1):
        step = (levels[k][a] == levels[k][b]).astype(np.int32) << k
        a, b = a + step, b + step
        lcp[at + 1] += step
    return lcp


def sparse_table(values: np.ndarray, longest: int) -> list[np.ndarray]:
    """Entry k, i: the least of the 2^k values from i on; for ranges of up to `longest` values."""
    table = [values]
    while 2 ** len(table) <= min(longest, len(values)):
        half = 2 ** (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    return table


class CommonPrefix:
    """How many symbols two suffixes have in common, for many pairs of places at once."""

    def __init__(self, levels: list[np.ndarray], longest: int):
        self.rank = levels[-1]
        self.table = sparse_table(common_prefixes(levels), longest)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.zeros(len(i), dtype=np.int64)
        for k in np.unique(level).tolist():
            own = level == k
            t = self.table[k]
            out[own] = np.minimum(t[low[own]], t[high[own] - 2**k])
        return out


def next_smaller(rank: np.ndarray, longest: int) -> np.ndarray:
    """The next place with a smaller rank, len(rank) if there is none within `longest` places."""
    n = len(rank)
    out = np.full(n, n, dtype=np.int64)
    left = np.arange(n)
    for d in range(1, NEAR + 1):
        left = left[left + d < n]
        hit = rank[left + d] < rank[left]
        out[left[hit]] = left[hit] + d
        left = left[~hit]
    table = sparse_table(rank, longest)
    own, at = rank[left], left + NEAR + 1
    for k in range(len(table) - 1, -1, -1):  # over stretches without a smaller one, the longest first
        inside = np.flatnonzero(at + 2**k <= n)
        inside = inside[table[k][at[inside]] > own[inside]]
        at[inside] += 2**k
    found = at < n
    found[found] = rank[at[found]] < own[found]
    out[left[found]] = at[found]
    return out


def runs_of(texts: list[list], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[np.ndarray]:
    """(start, length, period) of the runs of each list of words, by start, then period: maximal stretches of period q
    (no smaller one) with least_words words and least_periods * q at least (2 q or more)."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    first = np.r_[0, np.cumsum(size + 1)]  # a symbol of its own ends every text
    n, longest = int(first[-1]), int(size.max(initial=0)) + 1
    none = np.zeros((0, 3), dtype=np.int64)
    if longest <= least_words:
        return [none] * len(texts)
    symbols = np.zeros(n, dtype=np.int64)
    for k, words in enumerate(texts):
        number: dict = {}
        symbols[first[k] : first[k + 1] - 1] = [number.setdefault(w, len(number)) for w in words]
    text = np.repeat(np.arange(len(texts)), size + 1)
    symbols += 1 + first[text]  # no number is used by two texts
    symbols[first[1:] - 1] = first[:-1]  # the end sorts before all words of its text
    mirror = first[text] + first[text + 1] - 2 - np.arange(n)
    mirror[first[1:] - 1] = first[1:] - 1
    back = np.empty_like(symbols)
    back[mirror] = symbols
    levels = suffix_ranks(symbols)
    rank = levels[-1]
    i, p = [], []
    for order in (rank, -rank):
        end = next_smaller(order, longest)
        ok = np.flatnonzero(end < first[text + 1])
        i.append(ok)
        p.append(end[ok] - ok)
    i, p = np.concatenate(i), np.concatenate(p)
    real = i != first[text[i] + 1] - 1
    i, p = i[real], p[real]
    begins = i == first[text[i]]
    goes_on = (symbols[i] == symbols[i + p]) | (~begins & (symbols[i - 1] == symbols[i + p - 1]))
    goes_on &= least_periods * p <= size[text[i]]
    i, p, begins = i[goes_on], p[goes_on], begins[goes_on]
    if not len(i):
        return [none] * len(texts)
    on = CommonPrefix(levels, longest)(i, i + p)
    del levels, rank
    before = np.zeros(len(i), dtype=np.int64)
    inner = np.flatnonzero(~begins)
    # by how much it goes on to the left only matters where there can be enough of it
    before[inner] = CommonPrefix(suffix_ranks(back), longest)(mirror[i[inner] - 1], mirror[i[inner] + p[inner] - 1])
    start, length = i - before, p + on + before
    enough = length >= np.maximum(least_words, least_periods * p)
    found = np.unique(np.stack([start, p, length], axis=1)[enough], axis=0)
    whose = text[found[:, 0]]
    cut = np.searchsorted(whose, np.arange(len(texts) + 1))
    return [np.stack([found[a:b, 0] - first[k], found[a:b, 2], found[a:b, 1]], axis=1) if b > a else none for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each of n words is kept when every run is cut back to its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge)[:n] == 0


_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """`id_col`, n_words, runs (start, length and period of each, by start, then period) and collapsed: the words that
    no run holds after its first period, one space between."""

    def make():
        def work(texts: list[str]):
            words = [t.encode("utf-8", "surrogatepass").split() for t in texts]  # bytes.split() parts at 0x20 and 0x09 to 0x0D
            runs = runs_of(words, least_words, least_periods)
            left = [[w[k] for k in np.flatnonzero(kept_words(len(w), r)).tolist()] if len(r) else w for w, r in zip(words, runs, strict=True)]
            return [len(w) for w in words], [[tuple(x) for x in r.tolist()] for r in runs], [b" ".join(w).decode("utf-8", "surrogatepass") for w in left]

        return work

    fields = [("n_words", T.LongType()), ("runs", T.ArrayType(_RUN)), ("collapsed", T.StringType())]
    return map_texts(docs, text_col, [id_col], fields, make)


# ---- the registered query ----


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col` and `text_col`; in a tenth of the documents, by the checksum h of the id, the words from a on repeat the
    first p of them: a = floor(h / 10) mod n, p = 1 + floor((n - a) / (3 + floor(h / 10) mod 8)) of n words.  Rows with
    a null id stay as they are."""
    h = F.crc32(F.col(quoted(id_col)).cast("string"))
    words = F.regexp_extract_all(F.col(quoted(text_col)), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    df = docs.select(F.col(quoted(id_col)), F.col(quoted(text_col)), h.alias("__h"), F.when(h % 10 == 0, words).alias("__w"))
    g, n = F.floor(F.col("__h") / 10), F.size("__w")
    df = df.withColumns({"__g": g.cast("long"), "__n": n.cast("long")})
    df = df.withColumn("__a", F.when(F.col("__n") > 0, F.col("__g") % F.col("__n")))
    df = df.withColumn("__p", 1 + F.floor((F.col("__n") - F.col("__a")) / (3 + F.col("__g") % 8)))
    at = lambda i: F.when(i < F.col("__a"), i).otherwise(F.col("__a") + (i - F.col("__a")) % F.col("__p"))
    text = F.array_join(F.transform("__w", lambda x, i: F.get("__w", at(i).cast("int"))), " ")
    # a null text has no words, and so has one of white space alone
    return df.select(F.col(quoted(id_col)), F.when(F.col("__n") > 0, text).otherwise(F.col(quoted(text_col))).alias(text_col))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of periodic_runs(): n_runs, the longest run (ties: smallest start, then period) and checksums of all runs and of
    the collapsed text."""
    line: Column = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    df = found.withColumn("__best", best)
    start, length, period = -F.col("__best.back"), F.col("__best.length"), -F.col("__best.short")
    return df.select(
        F.col(quoted(id_col)), F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def run_query(docs: DataFrame) -> DataFrame:
    return digests(periodic_runs(planted(docs)))
