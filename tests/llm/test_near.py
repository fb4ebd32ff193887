"""Near copies of documents and of vectors against brute force."""

import random
import re

import numpy as np
import pytest

from nearfold.llm import blocks, minhash, pivots
from nearfold.llm.components import components

W = re.compile(r"[^\x20\x09-\x0D]+")


def parts(nodes, edges):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def shingles(t):
    w = W.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) > 3 else frozenset([tuple(w)] if w else [])


def test_components(spark):
    rng = random.Random(3)
    path = [(k, k + 1) for k in range(100, 160)]
    star = [(500, k) for k in range(501, 560)]
    more = [(rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(60)]
    edges = path + star + more + [(7, 7), (8, 9), (9, 8)]
    want = parts({x for e in edges for x in e}, edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(n, n) == c for n, c in want.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_minhash_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 8)
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    docs = []
    for g in range(25):
        base = rng.choices(vocabulary, k=rng.randint(30, 120))
        for _ in range(rng.randint(1, 12) if g else 60):  # one group over many blocks
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            docs.append(" ".join(w))
    docs += [docs[0]] * 30 + ["", None, "one two", "ONE  two", "a b c d", "a b c d e"]
    rows = list(enumerate(docs))
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    sets = {i: shingles(t) for i, t in rows}
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = parts(sets, edges)
    got = {r.doc_id: r for r in minhash.near_groups(df).collect()}
    assert len(got) == len(rows)
    for i, s in sets.items():
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), want[i], want[i] == i)
    kept = minhash.drop_near_copies(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i in sets if want[i] == i}


def test_minhash_on_odd_rows(odd, none):
    got = minhash.near_groups(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.component_id for r in by[6]] == [6, 6] and by[7][0].component_id == 6 and not by[7][0].kept
    assert by[None][0].component_id is None and by[None][0].kept
    assert all(by[k][0].component_id == k and by[k][0].kept and by[k][0].n_shingles == 0 for k in (2, 3, 4))
    assert minhash.near_groups(none).count() == 0
    kept = [r.doc_id for r in minhash.drop_near_copies(odd).collect()]
    assert kept.count(6) == 1 and 7 not in kept and None in kept and {2, 3, 4} <= set(kept)


def test_one_id_for_different_texts(spark):
    """Nothing that is nobody's copy goes, whatever other row has its id; of equal rows one stays."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    near = c.replace("c30", "x")
    rows = [(5, a, "1"), (6, a, "2"), (6, b, "3"), (6, b, "4"), (7, "", "5"), (7, "", "5"), (8, c, "6"), (8, near, "7"), (9, None, "8"), (None, a, "9")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    kept = sorted((tuple(r) for r in minhash.drop_near_copies(df).collect()), key=str)
    ours = [r for r in kept if r[0] == 8]
    assert len(ours) == 1 and ours[0] in rows
    assert [r for r in kept if r[0] != 8] == sorted([(5, a, "1"), (6, b, "3"), (7, "", "5"), (7, "", "5"), (9, None, "8"), (None, a, "9")], key=str)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_groups(df).collect() if r.doc_id in (5, 6, 8))
    assert got == [(5, 57, 5), (6, 57, 5), (6, 57, 6), (6, 57, 6), (8, 57, 8), (8, 57, 8)]


def test_words_that_a_weak_hash_cannot_tell_apart(spark):
    """Texts that share nothing: words of letters in the order of Thue and Morse, and with both letters exchanged."""
    t = "".join("ab"[k.bit_count() % 2] for k in range(1024))
    df = spark.createDataFrame([(1, f"w x y {t}"), (2, "w x y " + t.translate({97: "b", 98: "a"}))], "doc_id long, text string")
    assert minhash.near_groups(df).where("kept").count() == 2


def test_exact_numbers_of_shingles():
    texts = ["a b c d e", "a b c d e a b c d", "a b", "a  B", "e d c b a", "a b c d f", "x"]
    n = minhash.Numbers()
    got = n.sets(n.of(texts), 4)
    want = [shingles(t) for t in texts]
    for p in range(len(texts)):
        for q in range(len(texts)):
            assert len(np.intersect1d(got[p], got[q])) == len(want[p] & want[q]) and len(got[p]) == len(want[p])


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**62, 900)
    b = np.r_[a[:800], rng.integers(0, 2**62, 100)]
    s = minhash.signatures([np.unique(a), np.unique(b)])
    assert abs((s[0] == s[1]).mean() - 800 / 1000) < 0.15


@pytest.mark.parametrize("listed", [4096, 0])
def test_pivots_against_brute_force(spark, monkeypatch, listed):
    """With lists by one pivot, and by two."""
    monkeypatch.setattr(pivots, "BLOCK", 64)
    monkeypatch.setattr(pivots, "LISTED", listed)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(700, 24))
    z = x[:150] / np.linalg.norm(x[:150], axis=1)[:, None]
    r = rng.normal(size=z.shape)
    r -= (r * z).sum(1)[:, None] * z
    r /= np.linalg.norm(r, axis=1)[:, None]
    c = rng.uniform(0.9, 0.93, 150)[:, None]  # the hardest links
    group = x[200] + 0.05 * rng.normal(size=(200, 24))
    v = np.vstack([x, c * z + np.sqrt(1 - c * c) * r, group, np.repeat(x[300:301], 40, axis=0), 3 * x[301:302]])
    rows = [(k, list(map(float, a))) for k, a in enumerate(v)]
    odd = [(9001, None), (9002, [0.0] * 24), (9003, [None] + [1.0] * 23), (9004, [float("nan")] * 24), (9005, [float("inf")] + [0.0] * 23), (9006, []), (None, list(map(float, x[300]))), (9007, [1.0, 2.0]), (9008, [1e300] * 24), (9009, [1e-300] * 24)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("n_links", __import__("pyspark").sql.functions.lit("x"))
    got = {r.vec_id: r for r in pivots.near_vectors(df).collect()}
    assert len(got) == len(rows) + len(odd)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    found = np.array([got[k].n_links for k in range(len(v))])
    assert (found <= link.sum(1)).all() and found.sum() >= 0.99 * link.sum()
    want = parts(range(len(v)), [tuple(e) for e in np.argwhere(link)])
    assert np.mean([got[k].component_id == want[k] for k in range(len(v))]) > 0.99
    for k in (9001, 9002, 9003, 9004, 9005, 9006, 9007):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)
    assert got[None].component_id is None and got[None].kept
    assert got[9008].n_links == got[9009].n_links == 1 and got[9009].component_id == 9008
    assert pivots.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("mean, wanted", [(0.7, 312), (0.8, 312), (0.8, 8192)])
def test_recall_with_a_common_mean(spark, monkeypatch, mean, wanted):
    """Vectors whose cosine is `mean` on average, where few pivots are shared at 0.9 unless more of them describe a vector."""
    monkeypatch.setattr(pivots, "PIVOTS", (wanted, wanted))
    rng = np.random.default_rng(3)
    n = wanted + 4000
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    make = lambda n: unit(np.r_[1, np.zeros(63)] * mean**0.5 + rng.normal(size=(n, 64)) * ((1 - mean) / 64) ** 0.5)
    v = make(n)
    one, d = v[:1000], make(1000) - make(1000)
    d = unit(d - (d * one).sum(1, keepdims=True) * one)
    c = rng.uniform(0.9, 0.92, (1000, 1))
    v = np.vstack([v, c * one + np.sqrt(1 - c * c) * d])
    got = {r.vec_id: r.n_links for r in pivots.near_vectors(spark.createDataFrame([(k, list(map(float, x))) for k, x in enumerate(v)], "vec_id long, embedding array<double>")).collect()}
    asked = np.r_[np.arange(0, 1000, 5), np.arange(1000, len(v), 20)]
    want = (v[asked] @ v.T >= 0.9).sum(1) - 1
    found = np.array([got[k] for k in asked])
    assert (found <= want).all() and found.sum() >= 0.95 * want.sum() and want.sum() > 250
    assert pivots.recall_at(v[:300], v[1000 : 1000 + wanted], (12,))[0] < (1 if wanted < 8192 else 0.5)


def test_the_pipeline_takes_shingles_of_five_words(spark):
    """Two texts that are near copies by four words, 72 of 88 shared, and not by five, 69 of 89."""
    import corpus_pipeline

    one = [f"w{k}" for k in range(83)]
    other = [f"x{k}" if k in (25, 55) else w for k, w in enumerate(one)]
    near = [f"x{k}" if k == 40 else w for k, w in enumerate(one)]
    df = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(other))], "doc_id long, text string")
    assert [r.doc_id for r in minhash.near_groups(df).where("kept").collect()] == [1]
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()) == [1, 2]
    df = df.where("doc_id = 1").union(spark.createDataFrame([(3, " ".join(near))], df.schema))
    assert [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()] == [1]


def test_columns_whose_names_have_dots(spark):
    """Filters keep all columns, whatever their names."""
    from nearfold.llm.texts import map_texts

    rows = [(1, "one two three four five six", 7, "x"), (2, "one two three four five six", 8, "y"), (3, "else", 9, None)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "a.b", "c`d"])
    assert sorted(tuple(r) for r in minhash.drop_near_copies(df).collect()) == [rows[0], rows[2]]
    kept = map_texts(df, "text", df.columns, [], lambda: lambda texts: [[len(t) for t in texts]], lambda got: [n > 5 for n in got[0]])
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
