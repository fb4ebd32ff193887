"""Fingerprints, spelling variants and periodic runs."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from nearfold.llm import fingerprints, repeats, spellings

from .conftest import LONG, ROWS

# ---- fingerprints ----


def cuts_of(symbols):
    """Where phrases begin, one text, plainly: symbols are whole numbers, neighbours differ."""
    n = len(symbols)

    def toss(x):
        out = [0]
        for a, b in zip(x, x[1:], strict=False):
            k = ((a ^ b) & -(a ^ b)).bit_length() - 1
            out.append(0 if a == b else 2 * k + (b >> k & 1))
        return out

    label = toss(symbols)
    for _ in range(2 if max(symbols) < 256 else 3):
        label = toss(label)
    free = lambda *near: min({0, 1, 2} - set(near))
    label[0] = free(label[1] if n > 1 else 6)
    for c in (3, 4, 5):
        label = [free(label[k - 1], label[k + 1] if k + 1 < n else 6) if x == c else x for k, x in enumerate(label)]
    return [k for k in range(n) if k == 0 or (k < n - 1 and label[k - 1] < label[k] > label[k + 1])]


def test_phrases_are_cut_as_plainly():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab cd\xc3\xa9") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    name, text = next(fingerprints.parsed(texts))
    for k, t in enumerate(texts):
        folded = [c for j, c in enumerate(t) if j == 0 or t[j - 1] != c]
        cut = cuts_of(folded)
        assert (text == k).sum() == len(cut)
        assert len(cut) <= len(folded) // 2 + 1 and all(b - a <= 8 for a, b in zip(cut, [*cut[1:], len(folded)], strict=True))


def test_every_level_is_the_same_alone_and_together():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefgh é\n") for _ in range(rng.choice([1, 2, 3, 9, 80, 700, 5000]))) for _ in range(60)] + ["", "aaaa" * 500, LONG]
    assert fingerprints.fingerprint(texts) == [fingerprints.fingerprint([t])[0] for t in texts]
    assert {len(f) for f in fingerprints.fingerprint(texts)} == {fingerprints.SIZE}


def test_equal_stretches_have_equal_phrases_whatever_their_offset():
    rng = random.Random(3)
    common = "".join(rng.choice("abcdefghij ") for _ in range(4000))
    for _ in range(20):
        a, b = (("".join(rng.choice("0123456789") for _ in range(rng.randint(0, 50)))) for _ in range(2))
        levels = zip(fingerprints.parsed([(a + common).encode()]), fingerprints.parsed([(b + common).encode()]), strict=False)
        for (one, _), (two, _) in levels:
            # phrases that only one of the two has: a bounded number at the ends, however long the text
            differ = sum((collections.Counter(one.tolist()) - collections.Counter(two.tolist())).values())
            assert differ <= 40


def test_likeness_against_the_shared_part():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    likes, others = [], []
    for n in (15, 40, 150, 600, 3000):
        for _ in range(8):
            a, b = prose(n), prose(n)
            f, g, h = fingerprints.fingerprint([a, b, fingerprints.edited(a, b)])
            likes.append(fingerprints.likeness(f, h))
            others.append(fingerprints.likeness(f, g))
            assert fingerprints.likeness(f, f) == 1 and fingerprints.likeness(f, h) == fingerprints.likeness(h, f)
    assert 0.55 < np.mean(likes) < 0.8 and min(likes) > 0.3
    assert np.mean(others) < 0.06 and max(others) < 0.35
    line = "Over and over " * 400  # repeats itself: still two thirds shared
    f, h = fingerprints.fingerprint([line, fingerprints.edited(line, prose(2000))])
    assert fingerprints.likeness(f, h) > 0.3


def neighbours(rows):
    """(id, text) and the next text, plainly; equal ids are ordered by Spark's hash of the text and left to the caller."""
    return [(i, t or "", rows[(k + 1) % len(rows)][1] or "") for k, (i, t) in enumerate(rows)]


def test_every_document_meets_the_next(spark, none):
    rng = random.Random(5)
    rows = [(k * 3 - 200, None if k % 17 == 0 else "".join(rng.choice("abc dé") for _ in range(rng.choice([0, 1, 2, 5, 100, 3000])))) for k in range(400)]
    shuffled = rng.sample(rows, len(rows))
    df = spark.createDataFrame([(t, i, 1) for i, t in shuffled], "text string, doc_id long, fingerprint int").repartition(5)
    got = {r.doc_id: r for r in fingerprints.compare_neighbours(df).collect()}
    assert len(got) == len(rows)
    for i, t, after in neighbours(sorted(rows, reverse=True)):
        e = fingerprints.edited(t, after)
        f, g, h = fingerprints.fingerprint([t, e, after])
        assert tuple(got[i][1:5]) == (len(t), hashlib.sha256(e.encode()).hexdigest(), f, g)
        assert got[i].near_edited == fingerprints.likeness(f, g) and got[i].near_next == fingerprints.likeness(f, h)
    assert fingerprints.compare_neighbours(none).count() == 0
    one = fingerprints.compare_neighbours(df.where("doc_id = -194")).first()
    assert one.near_next == 1 and one.n_chars == len(dict(rows)[-194] or "")


def test_fingerprints_of_odd_rows_and_hot_ids(odd, spark):
    got = collections.Counter((r.doc_id, r.fingerprint) for r in fingerprints.compare_neighbours(odd).collect())
    assert got == collections.Counter((i, fingerprints.fingerprint([t or ""])[0]) for i, t in ROWS)
    alone = fingerprints.fingerprints(odd).where("doc_id = 3").first()
    assert alone.fingerprint == fingerprints.fingerprint([""])[0]
    # an id that a third of all rows have, and a third without one: every row once, and a ring of all of them
    rows = [(k if k < 300 else 77 if k < 600 else None, f"{k:04d}" * 3) for k in range(900)]
    hot = fingerprints.compare_neighbours(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(hot) == 900 and len({r.fingerprint for r in hot}) == 900
    assert collections.Counter(r.doc_id for r in hot) == collections.Counter(i for i, _ in rows)
    follower = {hashlib.sha256((f"{a:04d}" * 2 + f"{b:04d}").encode()).hexdigest(): (a, b) for a in range(900) for b in range(900)}
    after = dict(follower[r.edited_sha256] for r in hot)
    at, seen = 299, []
    for _ in range(900):
        seen.append(at)
        at = after[at]
    assert at == 299 and len(set(seen)) == 900
    assert [k for k in seen if k < 300] == list(range(299, -1, -1)) and all(k >= 600 for k in seen[-300:])


# ---- spelling variants ----


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants(rows):
    count = collections.Counter()
    for i, t in rows:
        for w in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            count[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    count = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    by = {w: [v for v in count if near(w, v)] for w in count}
    form = {}
    for w, others in by.items():
        best = min(others, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best and count[best] >= 10 * count[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n, len(by[w]), form[w] and count[form[w]]) for w, n in count.items())


def test_variants_against_all_pairs(spark, odd, none):
    rng = random.Random(6)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randint(6, 9))) for _ in range(60)] + ["ananananan", "aaaaaaaaa", "aaaaaaaa", "Ünïcode", "abababa"]
    rows = []
    for k in range(120):
        words = []
        for _ in range(60):
            w = rng.choice(stems[: rng.choice([5, 20, len(stems)])])
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abcé") + w[at:], w[:at] + rng.choice("abcé") + w[at + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        rows.append((k, rng.choice([" ", "1", ", "]).join(words)))
    rows += [(k, "letterword " * 450 + "letterwordz " * 40 + "letterwordzz " * 3) for k in range(200, 203)]  # a chain of forms
    df = spark.createDataFrame([(t, i, "x", 1) for i, t in rows], "text string, doc_id long, word string, n int").repartition(3)
    want = variants(rows)
    assert sum(r[1] is not None for r in want) > 50 and any(r[1] and r[2] != r[1] for r in want)
    assert sorted(tuple(r) for r in spellings.variant_query(df).collect()) == want
    assert sorted(tuple(r) for r in spellings.variant_query(odd).collect()) == variants(ROWS)
    assert spellings.variant_query(none).count() == 0


def test_prefix_keys_meet_for_every_edit():
    """Any order of the bigrams will do: near words share a key, whatever the edit and however a word repeats itself."""
    rng = random.Random(7)
    for _ in range(4000):
        letters = rng.choice(["ab", "abc", "abcdefgh"])
        a = "".join(rng.choice(letters) for _ in range(rng.randint(7, 12)))
        at = rng.randrange(len(a) + 1)
        b = rng.choice([a[:at] + rng.choice(letters) + a[at:], a[:at] + rng.choice(letters) + a[at + 1 :]])
        if not near(a, b):
            continue
        grams = sorted({w[k : k + 2] for w in (a, b) for k in range(len(w) - 1)})
        rng.shuffle(grams)
        rank = {g: k for k, g in enumerate(grams)}
        assert spellings.keys_of(a, rank, True) & spellings.keys_of(b, rank, len(a) == len(b)), (a, b)


# ---- periodic runs ----


def runs_plainly(w, least_words=6, least_periods=4):
    """Period by period: stretches of places that agree with the place one period on."""
    out = set()
    x = np.unique(np.array(list(w)), return_inverse=True)[1] if len(w) else np.zeros(0)
    for q in range(1, len(w) // least_periods + 1):
        same = np.r_[False, x[:-q] == x[q:], False]
        edge = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
            n = e - s + q
            if n >= max(least_words, least_periods * q) and not any((x[s : s + n - r] == x[s + r : s + n]).all() for r in range(1, q)):
                out.add((s, n, q))
    return sorted(out, key=lambda x: (x[0], x[2]))


def row_plainly(i, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if i is not None and n:
        h = zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = runs_plainly(w)
    dropped = {k for s, m, q in runs for k in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (i, len(runs), *four, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in dropped)))


def test_runs_against_brute_force():
    rng = random.Random(8)
    for words, periods in ((6, 4), (2, 2), (3, 3)):
        for _ in range(400):
            texts = []
            for _ in range(rng.randint(0, 5)):
                t = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 40))]
                if len(t) > 4 and rng.random() < 0.5:
                    a, p = rng.randrange(len(t)), rng.randint(1, 6)
                    t = [t[a + (k - a) % p] if k >= a and a + (k - a) % p < len(t) else x for k, x in enumerate(t)]
                texts.append(t)
            assert [[tuple(x) for x in r.tolist()] for r in repeats.runs_of(texts, words, periods)] == [runs_plainly(t, words, periods) for t in texts]
    fib = ["a", "ab"]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    assert [tuple(x) for x in repeats.runs_of([list(fib[-1])], 2, 2)[0].tolist()] == runs_plainly(fib[-1], 2, 2)
    assert repeats.runs_of([["w"] * 50_000])[0].tolist() == [[0, 50_000, 1]]


def test_run_query_against_plain_python(spark, odd, none):
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choice(["x", "y", "Zé", "z"]) for _ in range(rng.randint(0, 60)))) for k in range(500)]
    df = spark.createDataFrame([(t, i, 1, "r") for i, t in rows], "text string, doc_id long, n_words int, runs string").repartition(3)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:].__repr__())
    assert sorted((tuple(r) for r in repeats.run_query(df).collect()), key=key) == sorted((row_plainly(i, t) for i, t in rows), key=key)
    assert sorted((tuple(r) for r in repeats.run_query(odd).collect()), key=key) == sorted((row_plainly(i, t) for i, t in ROWS), key=key)
    assert repeats.run_query(none).count() == 0
    spans = repeats.periodic_runs(odd.where(F.col("doc_id") == 5)).first()
    assert [tuple(r) for r in spans.runs] == [(0, 36_000, 6)] and spans.collapsed == "lorem ipsum dolor sit amet consectetur"
