"""Toxicity by a factorization machine over hashed terms.

Terms are the distinct words of a document and the first bytes of its longer words, hashed into 2**BITS places.  A
place has a linear weight and a vector of FACTORS numbers; a document's logit is the bias, the sum of its weights, and
the sum over all pairs of its terms of the product of their vectors, which learns what a pair says beyond its parts.
Fitted by AdaGrad on labelled documents.  Places that too few of these have stay out of the model, and so do those that
say nothing of the label beyond chance, neither alone nor in a pair with another place: a long document has hundreds of
those, and their noise would drown one insult.  A place that says nothing alone counts if the documents that have it
with some other place have another share of the label than both places by themselves would give.

Cases: a null or empty text has no terms and gets the bias alone; of a very long one all terms count; with nothing to learn from every score is 0.5; a null
id, repeated ids and rows each give their own row; other columns are never read; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from nearfold.llm.labelled import id_crc, sample_ids, sampled
from nearfold.llm.texts import IntTable, map_texts
from nearfold.llm.wordarrays import ALNUM, Hasher, mix, words_of

#: Labelled documents of each class that the machine is fitted on, at most.
TRAIN_PER_CLASS = 2_500
THRESHOLD = 0.5
BITS, FACTORS, PREFIX = 28, 4, 5
#: A place counts if so many training documents have it, and the chi-square of place and label is so high; or that of a
#: pair with it, higher by 2 ln(partners it could have), so that no more places than by themselves pass by chance.
LEAST, CHI_SQUARE = 3, 15.0
PAIR_BLOCK = 512
EPOCHS, BATCH, RATE, DECAY = 30, 64, 0.1, 1e-4


def terms(texts: list[str], hasher: Hasher, among: IntTable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places of all texts, text by text, and the bounds of each text's run; with `among`, what the table has
    for the places it knows, in place of all of them."""
    w = words_of(texts, ALNUM, hasher)
    text = w.text_of()
    long_ = w.ends - w.starts > PREFIX
    begun = w.starts[long_]
    prefix = mix(hasher(w.data, begun, begun + PREFIX).astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
    place = np.concatenate([w.hashes, prefix]) & ((1 << BITS) - 1)
    text = np.concatenate([text, text[long_]]).astype(np.int64)
    if among is not None:
        place = among.get(place).astype(np.int64)
        place, text = place[place >= 0], text[place >= 0]
    both = np.unique((text << BITS) | place)
    return both & ((1 << BITS) - 1), np.searchsorted(both >> BITS, np.arange(len(texts) + 1))


@dataclass
class FactorMachine:
    rows: IntTable  # of each place that counts: its row below
    weights: np.ndarray
    factors: np.ndarray
    bias: float

    def logits(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """rows: rows of the model, text by text; first: their bounds."""
        v = self.factors[rows]
        pairs = 0.5 * (_sums(v, first) ** 2 - _sums(v * v, first)).sum(axis=1)
        return self.bias + _sums(self.weights[rows], first) + pairs

    def score(self, texts: list[str], hasher: Hasher) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(*terms(texts, hasher, self.rows)), -40, 40)))


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros((len(x) + 1, *x.shape[1:]))
    np.cumsum(x, axis=0, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _beyond(n: np.ndarray, ones: np.ndarray, logit: np.ndarray) -> np.ndarray:
    """The likelihood-ratio statistic of `ones` of n documents against the share that `logit` says; 0 under LEAST."""
    n, ones = n.astype(float), ones.astype(float)
    says = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    with np.errstate(divide="ignore", invalid="ignore"):
        got = [2 * np.where(k > 0, k * np.log(k / (n * q)), 0.0) for k, q in ((ones, says), (n - ones, 1 - says))]
    return np.where(n >= LEAST, got[0] + got[1], 0.0)


def telling(place: np.ndarray, first: np.ndarray, labels: np.ndarray, spark: SparkSession | None = None) -> np.ndarray:
    """The places that pass LEAST and CHI_SQUARE, alone or in a pair.  The pairs are square in the places of the sample:
    with a session they are dealt to its executors, block by block."""
    known, of = np.unique(place, return_inverse=True)
    doc = np.repeat(np.arange(len(labels)), np.diff(first))
    n, ones = len(labels), labels.sum()
    have, both = np.bincount(of, minlength=len(known)), np.bincount(of, weights=labels[doc], minlength=len(known))
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = n * (both * n - have * ones) ** 2 / (have * ones * (n - have) * (n - ones))
    alone = (have >= LEAST) & (np.nan_to_num(chi) >= CHI_SQUARE)
    enough, passed = have >= LEAST, alone.copy()
    base = np.log((ones + 0.5) / (n - ones + 0.5))
    logit = np.log((both + 0.5) / (have - both + 0.5)) - base
    # with a place that tells something alone
    by_place, bounds = doc[np.argsort(of, kind="stable")], np.r_[0, np.cumsum(have)]
    least = CHI_SQUARE + 2 * np.log(max(1, alone.sum()))
    for i in np.flatnonzero(alone):
        docs = by_place[bounds[i] : bounds[i + 1]]
        size = first[docs + 1] - first[docs]
        others = of[np.repeat(first[docs] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        own, m = np.unique(others, return_counts=True)
        toxic = np.bincount(np.searchsorted(own, others), weights=np.repeat(labels[docs], size), minlength=len(own))
        passed[own[(_beyond(m, toxic, base + logit[i] + logit[own]) >= least) & enough[own]]] = True
    # with any other; where both leave the label at its base rate, fewer documents than this cannot reach `least`
    least = CHI_SQUARE + 2 * np.log(max(1, enough.sum()))
    rest = np.flatnonzero(enough & ~alone & (have * 2 * np.log(n / min(ones, n - ones)) >= least))
    size = have[rest]
    own = by_place[np.repeat(bounds[rest] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    pairs = Pairs(own.astype(np.int32), np.r_[0, np.cumsum(size)], labels.astype(np.float32), logit[rest], float(base), float(least), PAIR_BLOCK)
    passed[rest[pairs.passing(spark)]] = True
    return known[passed]


@dataclass
class Pairs:
    """Places that say nothing alone, and which of them do in a pair."""

    docs: np.ndarray  # of the first place, then of the second, ...
    bounds: np.ndarray
    truth: np.ndarray
    logit: np.ndarray
    base: float
    least: float
    size: int  # places of a block

    def _cells(self, block: int) -> np.ndarray:
        """Places x documents of a block of places: 1 where the document has the place."""
        a, b = block * self.size, min((block + 1) * self.size, len(self.logit))
        out = np.zeros((b - a, len(self.truth)), dtype=np.float32)
        out[np.repeat(np.arange(b - a), np.diff(self.bounds[a : b + 1])), self.docs[self.bounds[a] : self.bounds[b]]] = 1
        return out

    def between(self, one: int, two: int) -> np.ndarray:
        """The places of two blocks that pass in a pair of one of each."""
        x, y = self._cells(one), self._cells(two).T
        rows, cols = one * self.size + np.arange(len(x)), two * self.size + np.arange(y.shape[1])
        m, toxic = x @ y, (x * self.truth) @ y
        # the statistic is 2 (toxic - m q)**2 / (m q (1 - q)) at most; only where that may reach `least` it is computed
        odds_of = np.exp(self.base + self.logit).astype(np.float32)
        odds = odds_of[rows, None] * np.exp(-self.base).astype(np.float32) * odds_of[cols]
        far = toxic * (1 + odds) - m * odds
        hit = (m >= LEAST) & (2 * far * far >= 0.99 * self.least * m * odds)
        a, b = np.nonzero(hit)
        hit[a, b] = _beyond(m[a, b], toxic[a, b], self.base + self.logit[rows[a]] + self.logit[cols[b]]) >= self.least
        hit &= rows[:, None] != cols
        return np.unique(np.r_[rows[hit.any(axis=1)], cols[hit.any(axis=0)]])

    def passing(self, spark: SparkSession | None) -> np.ndarray:
        blocks = -(-len(self.logit) // self.size)
        met = [(a, b) for a in range(blocks) for b in range(a, blocks)]
        if not met:
            return np.zeros(0, dtype=np.int64)
        if spark is None:
            return np.unique(np.concatenate([self.between(a, b) for a, b in met]))
        held = spark.sparkContext.broadcast(self)  # as bounded as the sample

        def run(batches):
            for batch in batches:
                some = [held.value.between(*met[k]) for k in batch.column("id").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(some)) if some else np.zeros(0, dtype=np.int64))], names=["place"])

        parts = min(len(met), 4 * spark.sparkContext.defaultParallelism)
        found = np.unique(spark.range(0, len(met), 1, parts).mapInArrow(run, "place long").toArrow().column("place").to_numpy())
        held.destroy()
        return found


def fit_machine(place: np.ndarray, first: np.ndarray, labels: np.ndarray, seed: int = 11, spark: SparkSession | None = None) -> FactorMachine:
    labels = np.asarray(labels, dtype=float)
    learns = len(labels) > 0 and labels.min() < labels.max()
    chosen = telling(place, first, labels, spark) if learns else place[:0]
    rng = np.random.default_rng(seed)
    table = IntTable(chosen, np.arange(len(chosen), dtype=np.int32))
    machine = FactorMachine(table, np.zeros(len(chosen)), rng.normal(0, 0.01, (len(chosen), FACTORS)), 0.0)
    if not learns:
        return machine
    row = table.get(place)
    bounds = np.r_[0, np.cumsum(row >= 0)][first]
    rows = row[row >= 0]
    squares_w, squares_v, square_b = np.full(len(machine.weights), 1e-6), np.full(machine.factors.shape, 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            own = [rows[bounds[i] : bounds[i + 1]] for i in batch]
            flat = np.concatenate(own)
            n = np.array([len(r) for r in own])
            cut = np.r_[0, np.cumsum(n)]
            v = machine.factors[flat]
            total = _sums(v, cut)
            logit = machine.bias + _sums(machine.weights[flat], cut) + 0.5 * (total**2 - _sums(v * v, cut)).sum(axis=1)
            slope = 1 / (1 + np.exp(-np.clip(logit, -40, 40))) - labels[batch]
            each = np.repeat(slope, n)
            used, of = np.unique(flat, return_inverse=True)
            gw = np.bincount(of, weights=each) / len(batch) + DECAY * machine.weights[used]
            gv = np.stack([np.bincount(of, weights=each * (np.repeat(total[:, k], n) - v[:, k])) for k in range(FACTORS)], axis=1) / len(batch) + DECAY * machine.factors[used]
            squares_w[used] += gw * gw
            squares_v[used] += gv * gv
            machine.weights[used] -= RATE * gw / np.sqrt(squares_w[used])
            machine.factors[used] -= 0.2 * RATE * gv / np.sqrt(squares_v[used])
            gb = float(slope.mean())
            square_b += gb * gb
            machine.bias -= RATE * gb / square_b**0.5
    return machine


def train(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> FactorMachine:
    """A machine fitted on at most 2 * TRAIN_PER_CLASS labelled documents, of which only hashed terms reach the driver."""
    rule = id_crc(id_col) % 5 != 0 if learn_from is None else learn_from
    ids = sample_ids(labels, label_col, rule, TRAIN_PER_CLASS, id_col)

    def make():
        hasher = Hasher()

        def work(texts: list[str]):
            place, first = terms(texts, hasher)
            return [[place[a:b].astype(np.int32) for a, b in zip(first[:-1], first[1:], strict=True)]]

        return work

    got = map_texts(sampled(docs, ids, text_col, id_col), text_col, [id_col, "label"], [("terms", T.ArrayType(T.IntegerType()))], make).toArrow().sort_by(id_col)
    if not got.num_rows:
        return fit_machine(np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0))
    place = pa.compute.list_flatten(got["terms"]).to_numpy().astype(np.int64)
    first = np.r_[0, np.cumsum(pa.compute.list_value_length(got["terms"]).to_numpy())].astype(np.int64)
    return fit_machine(place, first, got["label"].to_numpy().astype(float), spark=docs.sparkSession)


def score_toxicity(docs: DataFrame, machine: FactorMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, score and predicted for every row."""
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        hasher = Hasher()

        def work(texts: list[str]):
            score = held.value.score(texts, hasher)
            return score, (score >= THRESHOLD).astype(np.int32)

        return work

    return map_texts(docs, text_col, [id_col], [("score", T.DoubleType()), ("predicted", T.IntegerType())], make)


def drop_toxic(docs: DataFrame, machine: FactorMachine, text_col: str = "text") -> DataFrame:
    """The documents whose score stays under THRESHOLD, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        hasher = Hasher()
        return lambda texts: [held.value.score(texts, hasher)]

    return map_texts(docs, text_col, docs.columns, [("score", T.DoubleType())], make, lambda got: got[0] < THRESHOLD)


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_toxicity(docs, train(docs, labels))
    return scored.select("doc_id", (id_crc("doc_id") % 5 == 0).alias("held_out"), "score", "predicted")
