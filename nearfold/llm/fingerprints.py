"""Fingerprints of texts by locally consistent parsing.

A text's bytes are cut into phrases, those into phrases of phrases, and so on up to one for the whole text.  Where a
level is cut depends only on what stands next to the cut: a stretch of equal symbols counts as one symbol, every symbol is
labelled by the lowest bit in which it differs from the one before it (deterministic coin tossing), the labels in turn
by theirs, until there are six, then three, and a phrase begins where a label is greater than both neighbours'.  So equal
stretches of two texts are cut alike, whatever their offsets, but for a bounded number of phrases at both ends.  A
phrase is named by a hash of the symbols in it, without a dictionary: equal phrases have one name on every machine.

The occurrences of phrases of each level in SKETCHES (some 2, 6, 14 and 33 bytes each) are put into bins by one part of a
hash, and of each bin the least other part is kept.  The fingerprint writes down the name of the whole text and those
bins, SIZE characters in all.  The likeness of two fingerprints is the share of their texts' phrases that the other has too
(twice the common ones over the sum of both), estimated from the bins of the highest level of which both have enough and
that is clear in one of them: where a text repeats itself, whole stretches of it are one phrase on the levels above, and
say too little.

Cases: a null text counts as empty; all empty texts have one fingerprint, which is like no other (0) and like itself
(1); equal texts have equal fingerprints and a likeness of 1; a text is taken whole, however long, in memory of some 100
bytes for each of its own; repeated rows and rows with a null id give a row each; other columns are ignored, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfold.llm.texts import give_back, map_texts, quoted, sha, slices, small_batches
from nearfold.llm.wordarrays import Hasher, mixed

#: Bins of each level that is sketched.
SKETCHES = {1: 32, 2: 32, 3: 64, 4: 64}
#: Bins that hold something in both fingerprints, for their highest level to be compared that has so many; phrases of the
#: second level that make the first one needless.
ENOUGH, MANY = 24, 160
#: Phrases of a level for each of the next, some 2.4 as a rule: with more than the first number the first level is wanted
#: after all, with more than the second much of the text repeats itself: the next level is not clear, nor those above.
FOLDED = 2.55, 3.5
#: Characters of a bin; of the name of the whole text and the number of its last clear level; and of a fingerprint.
BIN, HEAD = 4, 17
SIZE = HEAD + BIN * sum(SKETCHES.values())
_EMPTY_BIN = "-" * BIN
_M = np.uint64(0x9E3779B97F4A7C15)
_RUN = np.uint64(0xC2B2AE3D27D4EB4F)


def _tossed(bits: int) -> np.ndarray:
    """The label of a symbol at the number (symbol before it) << bits | symbol, for symbols of `bits` bits: twice the
    lowest bit in which they differ, and that bit of the symbol."""
    a, b = np.meshgrid(np.arange(1 << bits), np.arange(1 << bits), indexing="ij")
    differ = a ^ b
    low = np.bitwise_count((differ & -differ) - 1).astype(np.int64)
    return np.where(differ == 0, 0, 2 * low + ((b >> np.minimum(low, bits)) & 1)).astype(np.uint8).ravel()


_BYTES, _SEVEN, _FOUR, _THREE = (_tossed(bits) for bits in (8, 7, 4, 3))
#: The least of 0, 1, 2 that is neither of two labels.
_FREE = np.array([[min({0, 1, 2} - {a, b}) for b in range(7)] for a in range(7)], dtype=np.uint8)


def _before(x: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Each entry's left neighbour; 0 at the heads of texts."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[heads] = 0
    return out


def _cuts(symbols: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Whether a phrase begins at each symbol; neighbours differ but at the heads of texts, where one always begins."""
    before = _before(symbols, heads)
    if symbols.dtype == np.uint8:
        label = _BYTES.take((before.astype(np.uint16) << 8) | symbols)
    else:
        differ = symbols ^ before
        lowest = differ & (~differ + np.uint64(1))
        low = np.bitwise_count(lowest - np.uint64(1)) & np.uint8(63)
        label = 2 * low + ((symbols & lowest) != 0)  # below 128
        label[heads] = 0
        label = _SEVEN.take((_before(label, heads).astype(np.uint16) << 7) | label)  # below 14
    label[heads] = 0
    for table, bits in ((_FOUR, 4), (_THREE, 3)):  # below 8, below 6
        label = table.take((_before(label, heads) << bits) | label)
        label[heads] = 0
    last = np.zeros(len(label), dtype=bool)
    last[heads[1:] - 1] = last[-1] = True
    beside = lambda at: np.where(last[at], np.uint8(6), label[np.minimum(at + 1, len(label) - 1)])
    label[heads] = _FREE[6, beside(heads)]  # only a head may share its label with the next symbol
    for c in (3, 4, 5):
        own = np.flatnonzero(label == c)
        label[own] = _FREE[label[own - 1], beside(own)]
    cut = np.zeros(len(label), dtype=bool)
    cut[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    cut &= ~last  # the last symbol begins no phrase of its own
    cut[heads] = True
    return cut


def _folded(names: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of equal symbols as one: symbols, where each began, with the end of all, and heads."""
    new = np.empty(len(names), dtype=bool)
    new[:1] = True
    np.not_equal(names[1:], names[:-1], out=new[1:])
    new[heads] = True
    at = np.flatnonzero(new)
    return names[at], np.append(at, len(names)), np.searchsorted(at, heads)


_hasher = Hasher(11)


def _named(symbols: np.ndarray, many: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Names of the phrases that begin at `start`: hashes of their symbols and of how often each stands there."""
    value = symbols.copy()
    again = np.flatnonzero(many > 1)
    value[again] = mixed(value[again] + many[again].astype(np.uint64) * _RUN)
    length = np.diff(np.r_[start, len(symbols)])
    name = mixed(mixed(length.astype(np.uint64) * _RUN) * _M + value[start])
    left = np.arange(len(start))
    for k in range(1, int(length.max())):
        left = left[length[left] > k]
        name[left] = mixed(name[left] * _M + value[start[left] + k])
    return name


def parsed(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Level by level from 1: the names of the phrases, and the numbers of the texts they are from.  Texts that are not
    empty; each is in all levels up to that in which it is one phrase."""
    data = b"".join(texts)
    symbols = np.frombuffer(data, dtype=np.uint8)
    size = np.array([len(t) for t in texts])
    heads = np.cumsum(size) - size
    whose = np.arange(len(texts))
    while len(whose):
        symbols, first, heads = _folded(symbols, heads)
        start = np.flatnonzero(_cuts(symbols, heads))
        if symbols.dtype == np.uint8:
            name = _hasher(data, first[start], np.r_[first[start[1:]], len(data)]).astype(np.uint64)
        else:
            name = _named(symbols, np.diff(first), start)
        heads = np.searchsorted(start, heads)
        phrases = np.diff(np.r_[heads, len(name)])
        yield name, np.repeat(whose, phrases)
        more = phrases > 1
        symbols, whose, phrases = name[np.repeat(more, phrases)], whose[more], phrases[more]
        heads = np.cumsum(phrases) - phrases


def _sketch(names: np.ndarray, text: np.ndarray, texts: int, bins: int) -> np.ndarray:
    """The least 16 bits of each bin of each text, 65536 for none.  A phrase that a text has several times counts as
    often: each occurrence is told apart by its number."""
    h = mixed(names ^ mixed(text.astype(np.uint64) + _M))
    order = np.argsort(h, kind="stable")
    new = np.r_[True, h[order[1:]] != h[order[:-1]]]
    at = np.arange(len(order))
    h = mixed(mixed(names[order] ^ _M) + (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64) * _RUN)
    out = np.full(texts * bins, 1 << 16, dtype=np.int32)
    np.minimum.at(out, text[order] * bins + (h % np.uint64(bins)).astype(np.int64), (h >> np.uint64(48)).astype(np.int32))
    return out.reshape(texts, bins)


def fingerprint(texts: list[str]) -> list[str]:
    """The fingerprint of each text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    full = [k for k, r in enumerate(raw) if r]
    out = ["0" * HEAD + _EMPTY_BIN * sum(SKETCHES.values())] * len(raw)
    if not full:
        return out
    levels, root, n = [], np.zeros(len(full), dtype=np.uint64), len(full)
    for name, text in parsed([raw[k] for k in full]):
        size = np.bincount(text, minlength=n)
        last = size[text] == 1
        root[text[last]] = name[last]
        if len(levels) <= max(SKETCHES):
            levels.append((name, text, size))
    sketches, clear = [], np.ones(n, dtype=np.int64)
    for level, bins in SKETCHES.items():
        if level > len(levels):
            sketches.append(np.full((n, bins), 1 << 16, dtype=np.int32))
            continue
        name, text, size = levels[level - 1]
        if level > 1:
            clear[(clear == level - 1) & (levels[level - 2][2] <= FOLDED[1] * size)] = level
        elif len(levels) > 1:
            above = levels[1][2]
            wanted = ((above < MANY) | (size > FOLDED[0] * above))[text]
            name, text = name[wanted], text[wanted]
        sketches.append(_sketch(name, text, n, bins))
    words = _WORDS[np.concatenate(sketches, axis=1)]
    for at, k in enumerate(full):
        out[k] = f"{root[at]:016x}{clear[at]}" + "".join(words[at].tolist())
    return out


_WORDS = np.array([f"{k:04x}" for k in range(1 << 16)] + [_EMPTY_BIN])


def likeness(a: str, b: str) -> float:
    """Share of two texts' phrases that they have in common, 0 to 1, from their fingerprints alone."""
    if a == b:
        return 1.0
    one, two = (np.frombuffer(x[HEAD:].encode(), dtype=f"S{BIN}") for x in (a, b))
    best, at, clear = 0.0, len(one), max(int(a[HEAD - 1]), int(b[HEAD - 1]))
    for level in sorted(SKETCHES, reverse=True):
        n = SKETCHES[level]
        at -= n
        p, q = one[at : at + n], two[at : at + n]
        in_one, in_two = p != _EMPTY_BIN.encode(), q != _EMPTY_BIN.encode()
        some, filled = int((in_one | in_two).sum()), min(int(in_one.sum()), int(in_two.sum()))
        if filled:
            same = int((in_one & (p == q)).sum())
            best = 2 * same / (some + same)
            if filled >= ENOUGH and level <= clear:
                break
    return best


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col` and fingerprint of every row."""
    return map_texts(docs, text_col, [id_col], [("fingerprint", T.StringType())], lambda: lambda texts: [fingerprint(texts)])


# ---- every document and the next one ----

#: Ranges of ids that each shuffled partition holds: so many that their sizes even out.
RANGES = 4
_LEAST = -(1 << 63)


def _ranges(docs: DataFrame) -> tuple[DataFrame, int, np.ndarray, int]:
    """`docs` (id, text) with k, the id or for null the least there is, and u, a hash of the text that orders equal ids;
    the number of partitions to deal to, and the borders of RANGES times as many ranges of k, of about equal numbers of
    rows.  Borders are one small array on the driver, found without reading a text."""
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    k = F.coalesce("id", F.lit(_LEAST))
    wanted = [j / (RANGES * n) for j in range(1, RANGES * n)]
    borders = docs.agg(F.percentile_approx(k, wanted, max(10_000, 10 * len(wanted))).alias("q")).first().q
    return docs.select("id", k.alias("k"), F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 1).alias("u"), "text"), n, np.array(borders or [], dtype=np.int64), len(wanted) + 1


def _dealt(docs: DataFrame) -> DataFrame:
    """(part, guest, id, text): all rows in descending order of ids, cut into parts, which are ordered inside
    partitions; each part ends in guests, the first of which is the first row of the next part (of the first one, after
    the last).  An id of very many rows is split by a hash of the text."""
    rows, n, borders, count = _ranges(docs)
    hot = len(np.unique(borders)) < len(borders)

    def part_of(k: np.ndarray, u: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(borders, k, side="left"), np.searchsorted(borders, k, side="right")
        return count - 1 - (low + (u / 2.0**63 * np.maximum(high - low, 1)).astype(np.int64)).clip(0, count - 1)

    def part(k: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series(part_of(k.to_numpy(), u.to_numpy()))

    # where no id has rows of several parts, the text is not read for this
    at = F.pandas_udf(part, "long")(F.col("k"), F.col("u") if hot else F.lit(0).cast("long"))
    first = F.max(F.struct("k", "u")) if hot else F.max(F.struct("k", F.lit(-1).cast("long").alias("u")))
    heads = rows.withColumn("part", at).groupBy("part").agg(first.alias("head")).orderBy("part").collect()  # a row for each part
    parts = [r.part for r in heads]
    before = dict(zip(parts, parts[-1:] + parts[:-1], strict=True))
    lead = {r.part: (r.head.k, r.head.u) for r in heads}

    def guest(k: pd.Series, u: pd.Series) -> pd.DataFrame:
        own = part_of(k.to_numpy(), u.to_numpy() if hot else np.zeros(len(u), dtype=np.int64))
        out = [before[p] if lead[p][0] == a and lead[p][1] in (-1, b) else -1 for p, a, b in zip(own.tolist(), k.tolist(), u.tolist(), strict=True)]
        return pd.DataFrame({"own": own, "before": out})

    both = F.pandas_udf(guest, "own long, before long")(F.col("k"), F.col("u"))
    rows = rows.withColumn("at", both)
    places = F.when(F.col("at.before") < 0, F.array(F.struct(F.col("at.own").alias("part"), F.lit(False).alias("guest")))).otherwise(
        F.array(F.struct(F.col("at.own").alias("part"), F.lit(False).alias("guest")), F.struct(F.col("at.before").alias("part"), F.lit(True).alias("guest")))
    )
    rows = rows.select("id", "k", "u", "text", F.explode(places).alias("to")).select("to.part", "to.guest", "id", "k", "u", "text")
    rows = rows.repartitionById(n, F.col("part").cast("int")).sortWithinPartitions("part", "guest", F.desc("k"), F.desc("u"), F.col("id").isNull(), "text")
    return rows.select("part", "guest", "id", "text")


_NAMES = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many first ones of the following text, or all it has."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[str], list[tuple[int | None, int, int]]]]:
    """Texts, and (id, place, place of the next document's text) of each document whose successor is among them."""
    held: tuple | None = None
    for batch in batches:
        for piece in slices(batch, "text"):
            rows = list(zip(*(piece.column(c).to_pylist() for c in ("part", "guest", "id", "text")), strict=True))
            rows = [held, *rows] if held else rows
            texts = [r[3] or "" for r in rows]
            yield texts, [(a[2], k, k + 1) for k, (a, b) in enumerate(zip(rows[:-1], rows[1:], strict=True)) if not a[1] and a[0] == b[0]]
            held = rows[-1]


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document, its edited text and the next document, in descending order of ids, of equal ids by their texts,
    null ids last, and the first one after the last: `id_col`, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next (likeness of the fingerprint to that of the edited text, and of the next document)."""
    columns = [F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).alias("text")]
    kinds = (T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.DoubleType(), T.DoubleType())
    schema = T.StructType([T.StructField(id_col, T.LongType()), *(T.StructField(c, t) for c, t in zip(_NAMES, kinds, strict=True))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, pairs in _pairs(batches):
            changed = [edited(texts[a], texts[b]) for _, a, b in pairs]
            own = fingerprint(texts + changed)
            after = own[len(texts) :]
            out = [
                [i for i, _, _ in pairs], [len(texts[a]) for _, a, _ in pairs], [sha(t.encode("utf-8", "surrogatepass")) for t in changed], [own[a] for _, a, _ in pairs], after,
                [likeness(own[a], e) for (_, a, _), e in zip(pairs, after, strict=True)], [likeness(own[a], own[b]) for _, a, b in pairs],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names=schema.names)
        give_back()

    return small_batches(_dealt(docs.select(*columns))).mapInArrow(run, schema)
