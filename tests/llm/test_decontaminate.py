import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from nearfold.llm import decontaminate as D

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return W.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items):
    patterns = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12)) if w and i is not None else ():
            patterns[tuple(w[k : k + 13])].add(str(i))
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for m in {len(p) for p in patterns}:
            for k in range(len(w) - m + 1):
                if found := patterns.get(tuple(w[k : k + m])):
                    hit.update(range(k, k + m))
                    ids |= found
        whole = any(tuple(w[k : k + 13]) in patterns for k in range(len(w) - 12))
        out.append((i, len(w), len(hit), sorted(ids), len(hit) > 0 and 20 * len(hit) >= len(w), whole))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [200_000, 3])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(D, "PATTERN_BLOCK", block)  # 3: many passes
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["a", "B", "c,", "dé", "1"]) for _ in range(n))
    items = [(k, text(n)) for k, n in enumerate((1, 2, 2, 3, 12, 13, 14, 20, 40))] + [(50, ""), (51, None), (None, "zz zz"), (0, "a B")]
    docs = [(k, text(rng.randint(0, 60))) for k in range(60)] + [(None, items[8][1]), (70, None), (71, ""), (72, (text(900) + " " + items[7][1] + " " + text(900))), (72, items[6][1]), (72, items[6][1])]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, __hits string").withColumns({c: F.lit("x") for c in ("found", "row", "items", "n", "n_hit", "hits", "item", "pattern", "contaminated")}).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in D.find_contamination(df, b).collect()), key=str)
    want = brute(docs, items)
    assert got == [x[:5] for x in want]
    kept = D.drop_contaminated(df, b)
    assert kept.columns == df.columns and kept.schema == df.schema
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [x[0] for x in want if not (x[4] or x[5])]


def test_odd_rows_and_no_benchmark(odd, none, spark):
    b = spark.createDataFrame([], "item_id long, text string")
    got = D.find_contamination(odd, b, digest=True).collect()
    assert len(got) == odd.count() and not any(r.contaminated or r.n_items for r in got)
    assert D.find_contamination(none, b).count() == 0
    assert sorted(D.drop_contaminated(odd, b).collect(), key=str) == sorted(odd.collect(), key=str)


def test_a_passage_in_a_long_document(spark):
    """The filter drops it for one whole window, though less than a twentieth is hit; a short item counts by its share."""
    passage, rest = " ".join(f"p{k}" for k in range(13)), " ".join(f"w{k}" for k in range(2000))
    docs = [(1, f"{rest} {passage} {rest}"), (2, rest + " common phrase"), (3, "one common phrase"), (4, rest + " " + passage[:-4]), (None, passage)]
    df, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, passage), (2, "common phrase")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.contaminated) for r in D.find_contamination(df, b).collect()}
    assert got == {1: (13, False), 2: (2, False), 3: (2, True), 4: (0, False), None: (13, True)}
    assert [r.doc_id for r in D.drop_contaminated(df, b).orderBy("doc_id").collect()] == [2, 4]
