"""Token counts and SentencePiece ids against the libraries."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nearfold.llm import token_counts
from nearfold.llm.pieces import PieceCodec, digest_pieces, encode_pieces
from nearfold.llm.token_counts import UnitCounter, count_tokens
from nearfold.llm.wordarrays import Hasher, words_of

from .conftest import ROWS

PIECES, UNITS = P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def codec():
    return PieceCodec(PIECES)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("ab  \n\te▁éth's1\r\x0b\x0c\x1c\x85\xa0\u2003\u3000"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(library, codec, text):
    ids = library.encode(text)
    assert codec.encode(text) == ids
    assert codec.decode(ids) == library.decode(ids)
    counter = UnitCounter(UNITS)
    assert counter.count([text]) == [len(counter.tokenizer.encode(text, add_special_tokens=False))]


def test_decode_of_any_ids(library, codec):
    rng = random.Random(1)
    for _ in range(2000):
        ids = [rng.choice((0, 1, 2, 3, rng.randint(0, 700))) for _ in range(8)]
        assert codec.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 2000, " " * 999, "é" * 500, "aaab" * 700])
def test_long_segments(library, codec, text):
    assert codec.encode(text) == library.encode(text)


def test_small_caches_change_nothing(library):
    keys = words_of(["the"], token_counts.UNITS, Hasher()).hashes
    counter = UnitCounter(UNITS, (keys, np.array([1])), entries=4)
    texts = [" ".join(random.Random(k).choices(["the", "of", "tokenisation", "it's", "naïve"], k=30)) for k in range(50)]
    for k in range(0, 50, 7):
        assert counter.count(texts[k : k + 7]) == [len(counter.tokenizer.encode(t, add_special_tokens=False)) for t in texts[k : k + 7]]


def test_queries_on_odd_rows(odd, none, library):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digest_pieces(odd, PIECES).collect())
    ids = [(i or -1, library.encode(t or "")) for i, t in ROWS]
    assert got == sorted((i, len(x), sha(",".join(map(str, x))), sha(library.decode(x))) for i, x in ids)
    assert sorted((r.doc_id or -1, r.ids) for r in encode_pieces(odd, PIECES).collect()) == sorted(ids)
    t = UnitCounter(UNITS).tokenizer
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(odd, UNITS).collect())
    want = [(i or -1, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False))) for i, x in ROWS]
    assert got == sorted((*w, w[2] > 2048) for w in want)
    assert digest_pieces(none, PIECES).count() == count_tokens(none, UNITS).count() == 0
