"""Quality, toxicity: held-out accuracy on the sample tables, and odd rows."""

import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfold.llm import quality, toxicity
from nearfold.llm.chain import fit_chain
from nearfold.llm.texts import IntTable
from nearfold.llm.wordarrays import Hasher


def area(score, y):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    return (rank[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()


@pytest.mark.parametrize("query, label, mod, rest, least", [(quality.quality_query, "quality", 4, 2, 0.99), (toxicity.toxicity_query, "toxic", 5, 0, 0.8)])
def test_held_out(spark, query, label, mod, rest, least):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in query(docs, labels).collect()}
    assert len(got) == docs.count()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % mod == rest) and 0 <= r.score <= 1
    rows = [(got[i].score, y) for i, y in duckdb.sql(f"select doc_id, {label} from '{d}/labels.parquet'").fetchall() if got[i].held_out]
    s, y = map(np.array, zip(*rows, strict=True))
    assert area(s, y) > least


@pytest.mark.parametrize("module, query, keep", [(quality, quality.quality_query, quality.keep_good), (toxicity, toxicity.toxicity_query, toxicity.drop_toxic)])
def test_odd_rows(odd, none, spark, module, query, keep):
    label = "quality" if module is quality else "toxic"
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = query(odd, no_labels).collect()
    assert len(got) == odd.count() and all(r.score == 0.5 for r in got)
    some = spark.createDataFrame([(1, 0, 1), (5, 1, 0), (6, 1, 0), (6, 1, 0), (None, 1, 1), (7, None, None), (99, 1, 1)], no_labels.schema)
    model = module.train(odd, some, learn_from=F.lit(True))
    kept = keep(odd, model)
    assert kept.columns == odd.columns and kept.count() <= odd.count()
    assert query(none, some).count() == 0 and label in some.columns


def test_chain_against_enumeration():
    """Marginals and the likeliest labels of short chains against all labellings."""
    import itertools

    rng = np.random.default_rng(1)
    field = fit_chain(np.array([[0], [1], [0]]), np.array([0, 2, 3]), np.array([0, 1, 1]), 4, 3, 0.1, 0.0)
    field.weights, field.turn, field.begin = rng.normal(size=4), rng.normal(size=(2, 2)), rng.normal(size=2)
    field.weights[-1] = 0
    ids, first = rng.integers(0, 3, (7, 2)), np.array([0, 4, 5, 7])
    post, _, _ = field.marginals(ids, first)
    best = field.viterbi(ids, first)
    for a, b in zip(first[:-1], first[1:], strict=True):
        emit = field.weights[ids[a:b]].sum(axis=1)
        score = {}
        for y in itertools.product((0, 1), repeat=b - a):
            s = field.begin[y[0]] + sum(emit[k] * y[k] for k in range(b - a)) + sum(field.turn[y[k - 1], y[k]] for k in range(1, b - a))
            score[y] = s
        total = sum(np.exp(s) for s in score.values())
        for k in range(b - a):
            assert np.isclose(post[a + k, 1], sum(np.exp(s) for y, s in score.items() if y[k]) / total)
        assert tuple(best[a:b]) == max(score, key=score.get)


def test_pairs_are_learned():
    """An interaction that no sum of single weights expresses."""
    rng = np.random.default_rng(2)
    rows, y = [], []
    for _ in range(1200):
        a, b = rng.integers(0, 2, 2)
        rows.append([10] * a + [20] * b + [30] * (1 - a) + [40] * (1 - b) + [int(rng.integers(50, 60))])
        y.append(int(a ^ b ^ 1))
    place, first = np.concatenate(rows), np.r_[0, np.cumsum([len(r) for r in rows])]
    old = toxicity.CHI_SQUARE
    toxicity.CHI_SQUARE = 0.0
    try:
        m = toxicity.fit_machine(place, first, np.array(y, float))
    finally:
        toxicity.CHI_SQUARE = old
    row = m.rows.get(place)
    assert (((m.logits(row, first)) > 0) == np.array(y)).mean() > 0.95


def test_pairs_are_learned_with_production_constants():
    """No place says anything alone, among forty noise words."""

    def made(n, seed):
        rng = np.random.default_rng(seed)
        rows, y = [], []
        for _ in range(n):
            a, b = rng.integers(0, 2, 2)
            y.append(int(a == b))
            rows.append(np.unique([10] * a + [20] * b + [30] * (1 - a) + [40] * (1 - b) + (100 + 3000 * rng.random(40) ** 3).astype(int).tolist()))
        return np.concatenate(rows), np.r_[0, np.cumsum([len(r) for r in rows])], np.array(y, float)

    m = toxicity.fit_machine(*made(1200, 2))
    place, first, y = made(600, 3)
    row = m.rows.get(place)
    assert ((m.logits(row[row >= 0], np.r_[0, np.cumsum(row >= 0)][first]) > 0) == y).mean() > 0.95


def test_a_neutral_mention_is_screened_in(spark, monkeypatch):
    """Insult and mention are toxic together only; the mention's own share of the label is the base rate."""
    rng = np.random.default_rng(4)
    rows, y = [], []
    for k in range(3000):
        kind = k % 6  # toxic: 0 to 2; the mention, 1, is in two of three of either
        own = {0: [1, 2], 1: [1, 2], 2: [3], 3: [1], 4: [1, 4], 5: [2, 4]}[kind]
        rows.append(np.unique([*own, *(100 + 500 * rng.random(10)).astype(int)]))
        y.append(float(kind < 3))
    place, first = np.concatenate(rows), np.r_[0, np.cumsum([len(r) for r in rows])]
    got = set(toxicity.telling(place, first, np.array(y)).tolist())
    assert {1, 2, 3, 4} <= got and len(got) < 12
    monkeypatch.setattr(toxicity, "PAIR_BLOCK", 50)  # many blocks, dealt to tasks: the same places
    assert set(toxicity.telling(place, first, np.array(y)).tolist()) == got == set(toxicity.telling(place, first, np.array(y), spark).tolist())


def test_the_logit_is_a_sum_over_all_pairs():
    """Of any texts, repeated words and none, place by place and pair by pair."""
    rng = np.random.default_rng(5)
    texts = ["you are a vile clown", "", "clown clown", "a kind neighbour and a vile winter", "unknown words only", "neighbour " * 50 + "vile"]
    hasher = Hasher()
    place = np.unique(toxicity.terms(["you are a vile clown and a kind neighbour"], hasher)[0])
    m = toxicity.FactorMachine(IntTable(place, np.arange(len(place), dtype=np.int32)), rng.normal(size=len(place)), rng.normal(size=(len(place), toxicity.FACTORS)), 0.3)
    rows, first = toxicity.terms(texts, hasher, m.rows)
    got = m.logits(rows, first)
    all_places, bounds = toxicity.terms(texts, hasher)
    for k in range(len(texts)):
        own = [int(np.searchsorted(place, p)) for p in all_places[bounds[k] : bounds[k + 1]] if p in place]
        want = 0.3 + sum(m.weights[i] for i in own) + sum(float(m.factors[i] @ m.factors[j]) for n, i in enumerate(own) for j in own[:n])
        assert np.isclose(got[k], want) and np.isclose(m.score(texts, hasher)[k], 1 / (1 + np.exp(-np.clip(want, -40, 40))))
