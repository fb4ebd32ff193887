"""Language-model scores of documents, and a unigram base to hold them against.

The model is the causal self-attention model of attention.py over the ids that a public SentencePiece vocabulary gives
the text's words (those of the base: A-Z lower-cased, apart by any white space); windows of WINDOW ids overlap by half,
each id is scored once, and the score is the log10 probability of all ids and the end.  It learns from every window of
every document to learn from: sums over all tasks give the counts of ids and of pairs of classes that it starts from; a
first fit on the driver, of STEPS steps on windows drawn from anywhere in the documents, gives the tasks a common place
to begin at; then ROUNDS rounds, each over its share of the documents, lead through all windows once, and every place of
each is predicted.  In a round every task goes on from the same parameters by itself, and the mean over all tasks,
weighted by windows, is what the next round begins with.  Rounds, tasks and what is drawn go by hashes of ids and texts,
and a task takes its documents in their order: how the rows lie changes no score.

The base's word counts cover the whole corpus.  Every task counts the words of its documents, the counts are summed by a
shuffle, and words come back to documents in two tiers: those with a share of 1 / FREQUENT_PARTS or more of all tokens,
of which there can be no more than FREQUENT_PARTS, by a broadcast table; the others, too rare to skew anything, by a
join on the word's 63-bit fingerprint.

Cases: a null or empty text has the end as its only token; a very long one is counted and scored whole, window by window; rows with a null id are learned from and not held out; with
nothing to learn from N and V are 0 and known is nothing; repeated ids and rows give a row each; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import zlib
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfold.llm.attention import BATCH, CLASSES, STEPS, WINDOW, AttentionModel, Descent, classes_of, cut_windows, last_window, pairs_of, start_model, stream, warm_up
from nearfold.llm.labelled import id_crc
from nearfold.llm.pieces import MARK, PieceCodec
from nearfold.llm.texts import IntTable, checkpoint, give_back, map_texts, quoted, slices, small_batches
from nearfold.llm.wordarrays import BLANK, Hasher, Words, words_of

#: Learning rates of the rounds; and ids of a round's task, at least, where there are so many.
ROUND_RATES, TASK_IDS = (0.004, 0.002, 0.001, 0.0005), 1_000_000
ROUNDS = len(ROUND_RATES)
#: Tasks whose parameters are added up at once.
SUMMED = 64
FREQUENT_PARTS = 1 << 21
#: Words, and ids of all words, in a worker's cache at most; when it is full, it begins anew.
CACHE_WORDS, CACHE_IDS = 1 << 20, 6 << 20


class WordIds:
    """Ids of the words of texts as arrays, with a cache by the words' fingerprints, itself of flat arrays."""

    def __init__(self, path: str):
        self.codec = PieceCodec(path)
        self._clear()

    def _clear(self) -> None:
        self.table = IntTable(np.zeros(0), np.zeros(0), CACHE_WORDS)
        self.begin, self.size = (np.zeros(CACHE_WORDS, dtype=np.int32) for _ in range(2))
        self.ids, self.words, self.used = np.zeros(CACHE_IDS, dtype=np.uint16), 0, 0

    def _make(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after the other, and the number of each word's."""
        codec = self.codec
        flat, ends = codec.merge([MARK + w for w in words])
        size = np.diff(np.r_[0, ends])
        if (odd := np.flatnonzero(flat >= codec.size)).size:  # characters outside the vocabulary
            spelled = [codec._fallback(i - codec.size) for i in flat[odd].tolist()]
            n = np.ones(len(flat), dtype=np.int64)
            n[odd] = [len(x) for x in spelled]
            size = np.diff(np.r_[0, np.cumsum(n)[ends - 1]])
            flat = np.repeat(flat, n)
            flat[np.repeat(np.isin(np.arange(len(n)), odd), n)] = [j for x in spelled for j in x]
        return flat.astype(np.uint16), size

    def __call__(self, w: Words) -> list[np.ndarray]:
        """The ids of each text, 16 bits each."""
        row = self.table.get(w.hashes)
        new, at = np.unique(w.hashes[row < 0], return_index=True)
        if len(new):
            at = np.flatnonzero(row < 0)[at]
            made, size = self._make([w.data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(w.starts[at].tolist(), w.ends[at].tolist(), strict=True)])
            if self.words + len(new) > CACHE_WORDS or self.used + len(made) > CACHE_IDS:
                self._clear()
                if len(new) > CACHE_WORDS or len(made) > CACHE_IDS:  # one text of very long words
                    return self._alone(w)
                return self(w)
            self.table.insert(new, np.arange(self.words, self.words + len(new)))
            self.begin[self.words : self.words + len(new)] = self.used + np.cumsum(size) - size
            self.size[self.words : self.words + len(new)] = size
            self.ids[self.used : self.used + len(made)] = made
            self.words, self.used = self.words + len(new), self.used + len(made)
            row = self.table.get(w.hashes)
        n = self.size[row]
        past = np.cumsum(n, dtype=np.int64)
        total = int(past[-1]) if len(past) else 0
        ids = self.ids[np.repeat(self.begin[row] - (past - n), n) + np.arange(total)]
        return np.split(ids, np.r_[0, past][w.first[1:-1]])

    def _alone(self, w: Words) -> list[np.ndarray]:
        made, size = self._make([w.data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(w.starts.tolist(), w.ends.tolist(), strict=True)])
        return np.split(made, np.r_[0, np.cumsum(size)][w.first[1:-1]])


@functools.lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One for all tasks of a worker."""
    return WordIds(path)


def _counts(docs: DataFrame, text_col: str) -> DataFrame:
    """word (fingerprint), n over all texts, the ends not among them."""

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            got = [words_of([t or "" for t in part.column(0).to_pylist()], BLANK, hasher).hashes for part in slices(batch, text_col)]
            word, n = np.unique(np.concatenate(got or [np.zeros(0, np.int64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n.astype(np.int64))], names=["word", "n"])

    return docs.select(text_col).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _arrays(values: list) -> list[np.ndarray]:
    return [np.frombuffer(x or b"", dtype=np.uint16) for x in values]


def _streams(batches, vocabulary: int):
    for batch in batches:
        for part in slices(batch, "ids"):
            yield stream(_arrays(part.column("ids").to_pylist()), vocabulary)


def _windows(batches, vocabulary: int):
    """All windows of a task's documents, in arrays of BATCH at most."""
    rest = np.array([vocabulary])
    for ids in _streams(batches, vocabulary):
        windows, rest = cut_windows(np.concatenate([rest, ids]))
        for at in range(0, len(windows), BATCH):
            yield windows[at : at + BATCH]
    if len(rest) > 2:
        yield last_window(rest)


def _windows_apart(texts: list[np.ndarray], vocabulary: int) -> np.ndarray:
    """The windows of each text by itself, whatever lies beside it, 16 bits an id: those that lie side by side, and one
    that goes round what is left."""
    flat = stream(texts, vocabulary).astype(np.uint16)
    n = np.array([len(t) for t in texts], dtype=np.int64)
    begin, full, place = np.cumsum(n + 2) - (n + 2), n // WINDOW, np.arange(WINDOW + 2)
    each = np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full)
    odd = n % WINDOW > 0
    left, size = (begin + full * WINDOW)[odd], (n % WINDOW + 2)[odd]
    return flat[np.concatenate([(np.repeat(begin, full) + each * WINDOW)[:, None] + place, left[:, None] + place % size[:, None]])]


def _drawn(batches, vocabulary: int, part: float):
    """About `part` of all windows of single documents, by their own hashes; a batch for each slice of documents."""
    size, bound = 2 * (WINDOW + 2), part * 2.0**32
    for batch in batches:
        for piece in slices(batch, "ids"):
            data = _windows_apart(_arrays(piece.column("ids").to_pylist()), vocabulary).tobytes()
            each = (data[at : at + size] for at in range(0, len(data), size))
            yield pa.RecordBatch.from_arrays([pa.array([w for w in each if zlib.crc32(w) < bound], pa.binary())], names=["window"])


def _counted(runs: DataFrame, vocabulary: int, size: int, cells) -> np.ndarray:
    """How often each of `size` cells occurs in the streams of all tasks; `cells` of a stream."""

    def run(batches):
        n = np.zeros(size, dtype=np.int64)
        for ids in _streams(batches, vocabulary):
            n += np.bincount(cells(ids), minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], names=["cell", "n"])
        give_back()

    got = small_batches(runs).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, dtype=np.int64)
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out


def _mean(rows: DataFrame, size: int, tasks: int) -> tuple[np.ndarray, int]:
    """The weighted mean of vectors, and the whole weight; rows: (weight, sum of `size` doubles) of
    `tasks` tasks.  A vector is some
    hundreds of KB; SUMMED of them are added up in a task, until so many are left for the driver."""

    def add(batches):
        total, weight = np.zeros(size), 0
        for b in batches:
            for w, v in zip(b.column("weight").to_pylist(), b.column("vector"), strict=True):
                total += np.frombuffer(v.as_buffer(), dtype=np.float64)
                weight += w
        if weight:
            yield pa.RecordBatch.from_arrays([pa.array([weight], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["weight", "vector"])

    while tasks > SUMMED:
        tasks = -(-tasks // SUMMED)
        rows = rows.repartition(tasks).mapInArrow(add, "weight long, vector binary")
    got = rows.toArrow()
    weight = sum(got.column("weight").to_pylist())
    total = sum((np.frombuffer(v, dtype=np.float64) for v in got.column("vector").to_pylist()), np.zeros(size))
    return total / max(1, weight), weight


def _round(runs: DataFrame, model: AttentionModel, rate: float, tasks: int) -> None:
    """One round: sets the model's parameters to the mean of what the tasks make of them."""
    vocabulary, names = model.vocabulary, list(model.p)
    size = sum(w.size for w in model.p.values())
    held = runs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = replace(held.value, p={name: w.copy() for name, w in held.value.p.items()})
        descent, seen = Descent(own), 0
        for windows in _windows(batches, vocabulary):
            descent.learn(own.cls[windows], rate * min(1.0, (descent.steps + 1) / 50))
            seen += len(windows)
        if seen:
            flat = np.concatenate([own.p[name].ravel() for name in names]).astype(np.float64) * seen
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([flat.tobytes()], pa.binary())], names=["weight", "vector"])
        give_back()

    mean, weight = _mean(small_batches(runs).mapInArrow(run, "weight long, vector binary"), size, tasks)
    held.unpersist()
    if weight:
        cut = np.cumsum([model.p[name].size for name in names])[:-1]
        for name, w in zip(names, np.split(mean, cut), strict=True):
            model.p[name] = w.reshape(model.p[name].shape).astype(np.float32)


def train(runs: DataFrame, vocabulary: int, steps: int = STEPS, seed: int = 3) -> AttentionModel:
    """The model, fitted on all rows; `runs`: key (a hash of what the row holds), ids (16 bits each)."""
    have = _counted(runs.select("ids"), vocabulary, vocabulary + 2, lambda ids: ids)
    cls, within = classes_of(have)
    rng = np.random.default_rng(seed)
    pairs = _counted(runs.select("ids"), vocabulary, CLASSES * CLASSES, lambda ids: pairs_of(ids, cls))
    model = start_model(cls, within, pairs, rng)
    total = int(have.sum())
    if not total:
        return model
    part = min(1.0, steps * BATCH * WINDOW / total)

    def drawn(batches):
        yield from _drawn(batches, vocabulary, part)

    got = sorted(small_batches(runs.select("ids")).mapInArrow(drawn, "window binary").toArrow().column("window").to_pylist())
    warm_up(model, np.frombuffer(b"".join(got), dtype=np.uint16).reshape(-1, WINDOW + 2), steps, rng)
    for k, rate in enumerate(ROUND_RATES):
        tasks = max(1, total // ROUNDS // TASK_IDS)
        own = runs.where(F.pmod("key", F.lit(ROUNDS)) == k).repartition(tasks, "key").sortWithinPartitions("key", "ids").select("ids")
        _round(own, model, rate, tasks)
    return model


def score_documents(docs: DataFrame, path: str, learn_from: Column | None = None, id_col: str = "doc_id", text_col: str = "text", steps: int = STEPS) -> DataFrame:
    """`id_col`, held_out, n_tokens, n_known, train_tokens, base_score and score for every row; `path`: a .model file."""
    spark = docs.sparkSession
    rule = F.coalesce(id_crc(id_col) % 5 != 1, F.lit(True)) if learn_from is None else learn_from
    learned = docs.where(rule)
    counts = checkpoint(_counts(learned, text_col))
    ends = learned.count()
    words, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, distinct = words + ends, kinds + (ends > 0)
    scale = np.log10(total + 0.5 * (distinct + 1))
    # no more than FREQUENT_PARTS words can have such a share
    top = counts.where(F.col("n") * FREQUENT_PARTS >= total).toArrow()
    held = spark.sparkContext.broadcast((top.column("word").to_numpy(), top.column("n").to_numpy().astype(np.int64)))

    def make():
        word, n = held.value
        table = IntTable(word, np.arange(len(word), dtype=np.int32))
        cost = np.log10(np.r_[n, 0] + 0.5) - scale
        hasher, ids = Hasher(), word_ids(path)

        def work(texts: list[str]):
            w = words_of(texts, BLANK, hasher)
            row = table.get(w.hashes)
            known = row >= 0
            text = w.text_of()
            base = np.bincount(text, weights=np.where(known, cost[row], 0.0), minlength=len(texts)) + np.log10(ends + 0.5) - scale
            sure = np.bincount(text, weights=known, minlength=len(texts)).astype(np.int64) + (ends > 0)
            rare = np.split(w.hashes[~known], np.cumsum(np.bincount(text[~known], minlength=len(texts)))[:-1])
            return np.diff(w.first) + 1, sure, base, [x.tobytes() for x in ids(w)], rare

        return work

    fields = [("n_tokens", T.LongType()), ("sure", T.LongType()), ("base", T.DoubleType()), ("ids", T.BinaryType()), ("rare", T.ArrayType(T.LongType()))]
    scored = docs.select(id_col, text_col, F.coalesce(~rule, F.lit(False)).alias("held_out"), F.coalesce(rule, F.lit(False)).alias("learned"))
    scored = checkpoint(map_texts(scored, text_col, [id_col, "held_out", "learned"], fields, make).withColumn("row", F.monotonically_increasing_id()))
    asked = scored.select("row", F.explode("rare").alias("word"))
    least = float(np.log10(0.5) - scale)
    found = asked.join(counts.where(F.col("n") * FREQUENT_PARTS < total), "word", "left").groupBy("row")
    found = found.agg(F.sum(F.coalesce(F.log10(F.col("n") + 0.5) - float(scale), F.lit(least))).alias("more"), F.count("n").alias("seen"))
    model = spark.sparkContext.broadcast(train(scored.where("learned").select(F.xxhash64(F.col(quoted(id_col)), "ids").alias("key"), "ids"), PieceCodec(path).size, steps))
    told = map_texts(scored, "ids", [id_col, "held_out", "n_tokens", "sure", "base", "row"], [("score", T.DoubleType())], lambda: lambda got: [model.value.score(_arrays(got))])
    out = told.join(found, "row", "left")
    return out.select(
        id_col,
        "held_out",
        "n_tokens",
        (F.col("sure") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )
