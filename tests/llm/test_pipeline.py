"""The pipeline, stage by stage, against plain Python over the same rows."""

import hashlib
import re

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nearfold.llm import quality, toxicity
from nearfold.llm.wordarrays import Hasher

from .test_decontaminate import brute

D = "/root/testdata/sf0.01"
W = re.compile(r"[^\x20\x09-\x0D]+")


def fives(t):
    w = W.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def without_near_copies(rows):
    sets = [fives(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            s, t = sets[a], sets[b]
            if s and t and 5 * min(len(s), len(t)) >= 4 * max(len(s), len(t)) and rows[a][0] is not None and rows[b][0] is not None:
                if 100 * len(s & t) >= 80 * len(s | t):
                    up[max(root(a), root(b))] = min(root(a), root(b))
    return [r for k, r in enumerate(rows) if not sets[k] or r[0] is None or root(k) == k]


@pytest.fixture(scope="module")
def docs(spark):
    """The table, with odd rows, and columns with names that the stages might use themselves."""
    rows = spark.read.parquet(f"{D}/documents.parquet")
    passage = spark.read.parquet(f"{D}/benchmark.parquet").first().text
    good = next(r.text for r in rows.orderBy("doc_id").collect() if len(r.text or "") > 3000)
    odd = [(900_001, None), (900_002, ""), (None, good), (900_003, good + "\n" + passage), (900_004, good), (900_004, good), (900_005, good[:-40] + " changed")]
    odd = spark.createDataFrame([(i, t, "en", "odd", 0) for i, t in odd], rows.schema)
    return rows.unionByName(odd).withColumns({c: F.lit("x") for c in ("score", "key", "row", "found", "first", "label")})


def test_stages_and_run(spark, docs):
    sf = D
    left = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    same = lambda a, b: sorted(map(str, a)) == sorted(map(str, b))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    now = docs
    for (name, stage), keep in zip(corpus_pipeline.STAGES[:4], ("good", "mild", "one", "clean"), strict=True):
        after = stage(spark, now, sf)
        assert [(f.name, f.dataType) for f in after.schema] == [(f.name, f.dataType) for f in docs.schema], name
        if keep == "good":
            model = quality.train(now, labels)
            want = [r for r, s in zip(left, model.score([t or "" for _, t in left], Hasher()), strict=True) if s >= quality.THRESHOLD]
        elif keep == "mild":
            model = toxicity.train(now, labels)
            want = [r for r, s in zip(left, model.score([t or "" for _, t in left], Hasher()), strict=True) if s < toxicity.THRESHOLD]
        elif keep == "one":
            want = without_near_copies(left)
        else:
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
            want = [r for r, x in zip(sorted(left, key=str), brute(left, items), strict=True) if not (x[4] or x[5])]
        got = [(r.doc_id, r.text) for r in after.collect()]
        assert same(got, want), name
        assert 0 < len(want) < len(left), name
        left, now = want, spark.createDataFrame(after.collect(), docs.schema)
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = [(i, ids, hashlib.sha256(library.decode(ids).encode()).hexdigest()) for i, ids in ((i, library.encode(t or "")) for i, t in left)]
    got = corpus_pipeline.apply(spark, docs, sf).collect()
    assert same([(r.doc_id, r.ids, r.decoded_sha256) for r in got], want) and all(r.n_tokens == len(r.ids) for r in got)


def test_an_empty_table(spark, docs):
    assert corpus_pipeline.apply(spark, docs.limit(0), D).count() == 0
