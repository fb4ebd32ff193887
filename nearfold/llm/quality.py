"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad.  Its features are statistics of the line and of both neighbours, cut into bins; transitions
tie neighbouring lines together.  The field is fitted on labelled documents, whose lines take the document's label, by
maximum conditional likelihood; forward-backward gives each line's probability of being good, and their mean weighted
by line length, mapped through a logistic curve fitted on the same sample, is the document's score.

Cases: a null or empty text is one empty line and gets a score; with no labelled row to learn from every score is 0.5;
a null id, repeated ids and rows each give their own row; other columns are never read; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from nearfold.llm.chain import ChainField, fit_chain
from nearfold.llm.labelled import id_crc, sample_ids, sampled
from nearfold.llm.texts import map_texts
from nearfold.llm.wordarrays import Hasher, mix

#: Labelled documents of each class that the field is fitted on, at most.
TRAIN_PER_CLASS = 1_500
THRESHOLD = 0.7
BINS = 8
EPOCHS, RATE, DECAY = 120, 0.1, 1e-3

_CLASS = np.zeros(256, dtype=np.uint8)  # 1 small letter, 2 capital, 3 digit, 4 usual punctuation, 5 other sign, 6 bar, 7 blank
_CLASS[33:127] = 5
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[ord(c) for c in ".,;:'\"-?()"]] = 4
_CLASS[ord("|")] = 6
_CLASS[[32, 9, 10, 11, 12, 13]] = 7
_CLASS[128:] = 1
_SHARES = np.array([0.0, 0.01, 0.03, 0.08, 0.2, 0.4, 0.7])
_SIZES = np.array([1, 3, 6, 12, 25, 60, 150])
_LENGTHS = np.array([1.0, 2.5, 3.5, 4.5, 6.0, 8.0, 12.0])
STATS = 9


def line_features(texts: list[str], hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of every line (lines x STATS), bytes of every line, and the number of each text's first line."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = b"\n".join(raw)
    buf = np.frombuffer(data, dtype=np.uint8)
    at = np.cumsum([0] + [len(r) + 1 for r in raw])
    cut = np.flatnonzero(buf == 10)
    starts, ends = np.r_[0, cut + 1], np.r_[cut, len(buf)]
    first = np.searchsorted(starts, at)
    first[-1] = len(starts)
    kind = _CLASS[buf]
    size = (ends - starts).astype(np.int64)

    def per_line(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, dtype=np.int32)
        np.cumsum(mask, out=total[1:])
        return total[ends] - total[starts]

    solid = kind != 7
    solid_n = np.maximum(1, per_line(solid))
    shares = [per_line(kind == k) / solid_n for k in (2, 3, 4, 5, 6)]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).astype(np.int8)))
    a, b = edge[0::2], edge[1::2]
    of = np.searchsorted(starts, a, side="right") - 1
    words = np.bincount(of, minlength=len(starts))
    h = hasher(data, a, b)
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    repeat = np.bincount(of, weights=same, minlength=len(starts)) / np.maximum(1, words)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    whole = mix(hasher(data, starts, ends).astype(np.uint64) + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, of_line, times = np.unique(whole, return_inverse=True, return_counts=True)
    twice = np.where(size > 0, np.minimum(times[of_line] - 1, BINS - 1), 0)
    cols = [np.searchsorted(_SHARES, s, side="left") for s in (*shares, repeat)]
    cols += [np.searchsorted(_SIZES, words, side="right"), np.searchsorted(_LENGTHS, solid_n / np.maximum(1, words), side="right"), twice]
    return np.stack(cols, axis=1).astype(np.uint8), size, first


def feature_ids(bins: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Feature numbers of each line: its own bins and those of the lines before and after, or of none there."""
    n = len(bins)
    block = STATS * (BINS + 1)
    own = bins.astype(np.int64) + np.arange(STATS) * (BINS + 1)
    none = BINS + np.arange(STATS) * (BINS + 1)
    before, after = np.vstack([none[None], own[:-1]]), np.vstack([own[1:], none[None]])
    before[first[:-1]] = none
    after[first[1:] - 1] = none
    return np.hstack([own, before + block, after + 2 * block]).reshape(n, 3 * STATS)


@dataclass
class LineField:
    field: ChainField
    curve: tuple[float, float] = (1.0, 0.0)

    def raw(self, bins: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Length-weighted mean probability of good lines of each text."""
        post, _, _ = self.field.marginals(feature_ids(bins, first), first)
        w = size + 1.0
        return np.add.reduceat(post[:, 1] * w, first[:-1]) / np.add.reduceat(w, first[:-1])

    def score(self, texts: list[str], hasher: Hasher) -> np.ndarray:
        return self.curved(self.raw(*line_features(texts, hasher)))

    def curved(self, mean: np.ndarray) -> np.ndarray:
        m = np.clip(mean, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.curve[0] * np.log(m / (1 - m)) + self.curve[1])))


def fit_field(bins: np.ndarray, size: np.ndarray, first: np.ndarray, labels: np.ndarray) -> LineField:
    """A field on lines that take their document's label, and the curve from mean marginals to labels."""
    features = 3 * STATS * (BINS + 1) + 1
    if len(labels) == 0 or labels.min() == labels.max():
        return LineField(ChainField(np.zeros(features), np.zeros((2, 2)), np.zeros(2)), (0.0, 0.0))
    line = LineField(fit_chain(feature_ids(bins, first), first, np.repeat(labels, np.diff(first)), features, EPOCHS, RATE, DECAY))
    m = np.clip(line.raw(bins, size, first), 1e-6, 1 - 1e-6)
    line.curve = logistic_curve(np.log(m / (1 - m)), labels)
    return line


def logistic_curve(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of P(1) = 1 / (1 + exp(-(a z + b))), by a few damped Newton steps, slightly held towards a = 1."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([((y - p) * z).sum() - (a - 1), (y - p).sum() - 0.1 * b])
        w = p * (1 - p)
        h = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.1]])
        d = np.linalg.solve(h, g)
        a, b = a + float(np.clip(d[0], -1, 1)), b + float(np.clip(d[1], -1, 1))
    return max(a, 0.05), b


def train(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> LineField:
    """A field fitted on at most 2 * TRAIN_PER_CLASS labelled documents, of which only line statistics reach the driver."""
    rule = id_crc(id_col) % 4 != 2 if learn_from is None else learn_from
    ids = sample_ids(labels, label_col, rule, TRAIN_PER_CLASS, id_col)

    def make():
        hasher = Hasher()

        def work(texts: list[str]):
            bins, size, first = line_features(texts, hasher)
            cut = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
            return [bins[a:b].tobytes() for a, b in cut], [size[a:b].tolist() for a, b in cut]

        return work

    fields = [("bins", T.BinaryType()), ("size", T.ArrayType(T.LongType()))]
    got = map_texts(sampled(docs, ids, text_col, id_col), text_col, [id_col, "label"], fields, make).toArrow().sort_by(id_col)
    if not got.num_rows:
        return fit_field(np.zeros((0, STATS), np.uint8), np.zeros(0), np.zeros(1, int), np.zeros(0))
    bins = np.frombuffer(b"".join(got["bins"].to_pylist()), dtype=np.uint8).reshape(-1, STATS)
    size = pa.compute.list_flatten(got["size"]).to_numpy()
    first = np.r_[0, np.cumsum(pa.compute.list_value_length(got["size"]).to_numpy())].astype(np.int64)
    return fit_field(bins, size, first, got["label"].to_numpy().astype(float))


def score_quality(docs: DataFrame, field: LineField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, score and predicted for every row."""
    held = docs.sparkSession.sparkContext.broadcast(field)

    def make():
        hasher = Hasher()

        def work(texts: list[str]):
            score = held.value.score(texts, hasher)
            return score, (score >= THRESHOLD).astype(np.int32)

        return work

    return map_texts(docs, text_col, [id_col], [("score", T.DoubleType()), ("predicted", T.IntegerType())], make)


def keep_good(docs: DataFrame, field: LineField, text_col: str = "text") -> DataFrame:
    """The documents whose score reaches THRESHOLD, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(field)

    def make():
        hasher = Hasher()
        return lambda texts: [held.value.score(texts, hasher)]

    return map_texts(docs, text_col, docs.columns, [("score", T.DoubleType())], make, lambda got: got[0] >= THRESHOLD)


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_quality(docs, train(docs, labels))
    return scored.select("doc_id", (id_crc("doc_id") % 4 == 2).alias("held_out"), "score", "predicted")
