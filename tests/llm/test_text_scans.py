"""Licences, pages, and language-model scores."""

import collections
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearfold.llm import attention, htmlpages, licenses, lm_score
from nearfold.llm.wordarrays import BLANK, Hasher, words_of

from .conftest import ROWS

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def base(text):
    w = W.findall((text or "").translate(LOW))
    at, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                at.append(k)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


LICENSED = [
    (20, "Licensed under the Apache License, Version 2.0. MIT license"), (21, "released under the MIT License."), (22, "This work is licensed under the GNU General Public License, version 3."),
    (23, "Licensed under CC BY-NC 4.0."), (24, "Redistribution and use in source and binary forms, with or without modification, are permitted provided"),
    (25, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"), (26, "mit dem license mit; license mit license mit license"), (27, "the of and to in for a or any use with"),
]


def test_licenses(odd, none, spark):
    rows = LICENSED + [(100 + k, "plain words of no licence at all and the rest") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    for i, t in rows:
        assert tuple(got[i][1:6]) == base(t)
        assert set(got[i].base_labels.split(",")) <= set(got[i].labels.split(",")) | {""} and 0 <= got[i].score <= 1
    assert [got[k].labels for k in (20, 21, 22, 23, 24, 25, 27)] == ["apache,apache-2.0,mit", "mit", "gpl,gpl-3.0", "cc-by-nc", "bsd", "mit", ""]
    assert got[100].labels == "" and got[100].score == 0
    odd_got = sorted((r.doc_id or -1, *r[1:6]) for r in licenses.scan_licenses(odd).collect() if r.doc_id != 1)
    assert odd_got == sorted((i or -1, *base(t)) for i, t in ROWS if i != 1)
    assert licenses.scan_licenses(none).count() == 0


def test_licenses_of_bundles(spark):
    """Every template of a file counts, whatever else stands there: against all alignments of all templates."""
    rng = random.Random(5)
    texts = [t for _, t, _ in licenses.TEMPLATES]
    rows = [(0, " and ".join(texts)), (1, texts[3] + " x " + texts[9]), (2, texts[12] + " x " + texts[13]), (3, texts[9] + " x " + texts[14]), (4, texts[9] + " x " + texts[10])]
    rows += [(5 + k, " ".join(w for t in rng.sample(texts, 4) for w in t.split() if rng.random() < 0.9)) for k in range(60)]
    rows += [(100 + k, "plain words of no licence at all and the rest") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    idf = licenses.idf_of(df)
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    for i, t in rows:
        w, want, best = W.findall(t.translate(LOW)), set(base(t)[4].split(",")), 0
        for label, text, keys in licenses.TEMPLATES:
            p = text.split()
            share = max(sum(idf[x] for k, x in enumerate(p) if 0 <= a + k < len(w) and w[a + k] == x) for a in range(-len(p), len(w))) / sum(idf[x] for x in p)
            if round(share, 6) >= licenses.AGREE and all(f" {key} " in f" {' '.join(w)} " for key in keys):
                want.add(label)
                best = max(best, share)
        assert got[i].labels == ",".join(sorted(want - {""})) and abs(got[i].score - best) < 2e-6
    assert set(got[0].labels.split(",")) == {label for label, _, _ in licenses.TEMPLATES} | set(licenses.BASE.values())
    assert [set(got[k].labels.split(",")) for k in (1, 3)] == [{"bsd", "isc"}, {"isc", "unlicense"}]


def test_licenses_of_paragraphs(spark):
    """Relatives with one sentence in common are told apart by the phrases that only one of them has."""
    whole = {label: text for label, text, keys in licenses.TEMPLATES if len(keys) > 1}
    two, three = whole["bsd-3-clause"].split(" 3 neither ")[0], whole["bsd-3-clause"]
    rows = [(1, two), (2, three), (3, whole["gpl-2.0-or-later"]), (4, whole["mit"].split(" subject ")[0]), (5, whole["boost-1.0"]), (6, whole["zlib"].upper())]
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "bsd", 2: "bsd,bsd-3-clause", 3: "gpl,gpl-2.0-or-later", 4: "mit", 5: "boost-1.0", 6: "zlib"}


def test_licenses_of_one_file(spark):
    """Words that every file has tell as much as their places do."""
    df = spark.createDataFrame([(1, LICENSED[5][1])], "doc_id long, text string")
    assert [(r.labels, r.score) for r in licenses.scan_licenses(df).collect()] == [("mit", 1.0)]
    many = spark.createDataFrame([(k, LICENSED[5][1]) for k in range(5)], "doc_id long, text string")
    assert {r.labels for r in licenses.scan_licenses(many).collect()} == {"mit"}


def test_hundreds_of_templates(spark):
    """One expression, whatever the number of templates; against all alignments of all of them."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    templates = []
    for k in range(500):
        t = [rng.choice(words) for _ in range(rng.randint(5, 30))]
        at = rng.randrange(len(t) - 3)
        templates.append((f"label-{k:03d}", " ".join(t), (" ".join(t[at : at + 3]),)))
    rows = [(k, " ".join([rng.choice(words) for _ in range(10)] + [w for w in rng.choice(templates)[1].split() if rng.random() < 0.95] + [rng.choice(words) for _ in range(5)])) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    idf = licenses.idf_of(df, templates=templates)
    found = 0
    for r in licenses.scan_licenses(df, templates=templates).collect():
        w, want = rows[r.doc_id][1].split(), set()
        for label, text, keys in templates:
            p = text.split()
            share = max(sum(idf[x] for k, x in enumerate(p) if 0 <= a + k < len(w) and w[a + k] == x) for a in range(-len(p), len(w))) / sum(idf[x] for x in p)
            if round(share, 6) >= licenses.AGREE and all(f" {key} " in f" {' '.join(w)} " for key in keys):
                want.add(label)
        found += len(want)
        assert r.labels == ",".join(sorted(want))
    assert found > 20


def test_licenses_stay_in_the_jvm(odd):
    plan = licenses.scan_licenses(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.fixture(scope="module")
def chain():
    return htmlpages.fit(300)


def test_made_pages(chain):
    rng = random.Random(77)
    pages = [htmlpages.labelled_page(rng) for _ in range(150)]
    assert np.mean([a == g for a, (_, g) in zip(htmlpages.extract([p for p, _ in pages], chain), pages, strict=True)]) > 0.9


def test_pages_of_the_tables(spark, chain, small):
    import html

    df = spark.read.parquet(f"{small}/pages.parquet")
    source = {r.page_id: r for r in df.collect()}
    for r in htmlpages.extract_pages(df, chain).collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", source[r.page_id].html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>?", "", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>", inner))
        assert r.text == " ".join(x for x in parts if x) and r.n_chars == len(r.text) and r.url == source[r.page_id].url


def test_odd_pages(spark, chain):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>one"), (4, "u", "<article><p>a &amp; b&nbsp;c &#233;<!-- x --><script>y</script></article>"), (5, "u", "<" * 50), (6, "u", "<!-- never ends"), (6, "u", "<!-- never ends"), (7, "u", "<article><p>" + "word " * 100000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in htmlpages.extract_pages(df, chain).collect()}
    assert got[1] == got[2] == got[6] == "" and got[4] == "a & b c é" and got[None] == "one" and len(got[7]) == 499_999
    assert htmlpages.extract_pages(df, chain).count() == len(rows)


def test_deep_pages_cost_no_more_for_each_level():
    """Blocks hold no list of their ancestors, and tags that are not open are not looked for."""
    n = 20_000
    began = time.process_time()
    blocks = htmlpages.parse("<div>x" * n + "</i>" * n)
    assert len(blocks) == n and time.process_time() - began < 5
    assert len({id(b.inside.tags) for b in blocks} | {len(b.inside.tags) for b in blocks}) <= n + 2 and max(len(b.inside.tags) for b in blocks) == 1
    inner = htmlpages.parse('<article><div class="ad"><article><p>a<li>b</article>c</div>d</article>e')
    assert [(b.text, b.inside.articles, b.inside.parent, sorted(b.inside.hints)) for b in inner] == [("a", 2, "p", []), ("b", 2, "li", []), ("c", 1, "div", ["ad"]), ("d", 1, "article", []), ("e", 0, "", [])]
    numbers = htmlpages.features(inner)
    apart = htmlpages._NUMBER["apart in article"], htmlpages._NUMBER["clean article"]
    assert [[x in f for x in apart] for f in numbers] == [[True, False]] * 3 + [[False, True], [False, False]]


ARTICLE = "<h1>A title of some words</h1><p>First paragraph, which has a number of words in it.</p><p>Second one, with a few more words to read.</p>"
SAID = "A title of some words First paragraph, which has a number of words in it. Second one, with a few more words to read."
AROUND = [
    "<body class='right-sidebar'><article>{}</article>", "<body class='home page top'><article>{}</article>", "<body id=top><article>{}</article>", "<body class='single-post has-sidebar logged-in'><article>{}</article>",
    "<body class='search comments'><article>{}</article>", "<div class='row no-sidebar'><article>{}</article></div>", "<div class='widget-area-left'><article>{}</article></div>", "<article class='post share'>{}</article>", "<article id='top'>{}</article>",
    "<div class='row no-sidebar'>{}</div>", "<div class='widget-area-left'>{}</div>", "<body class='right-sidebar'><div id=page>{}</div>", "<main class='top'>{}</main>", "<div class='content has-menu'>{}</div>", "<div class='post-content right-sidebar'>{}</div>",
    "<body class=top><header><a href=/>Site</a></header><div class='page-content left-sidebar'><article class='post meta'>{}</article><div class=sidebar><p>Something else to read here.</p></div></div><footer>&copy; us</footer>",
    "<div class='layout with-nav'><nav><a href=/a>one</a> <a href=/b>two</a></nav><main>{}</main></div>", "<div class='alert-free'><article>{}</article></div><div class='cookie-notice'><p>We use cookies on this site.</p></div>",
    "<article class='entry'>{}<div class='share'><a href=/s>tell others</a></div></article><section id='comments'><article class='comment'><p>I do not agree with any of it, and that at length, at length.</p></article></section>",
    "<div class='wrapper menu-open'><div class='sidebar'><p>Read this as well, dear reader.</p></div><div class='entry'>{}</div></div>", "<div itemprop='articleBody' class='form-free'>{}</div>", "<section class='top'><div><article>{}</article></div></section>",
    "<body class='page-template-sidebar'><div class='site-header-fixed'><article>{}</article></div>", "<td class='main top'>{}</td>",
]


@pytest.mark.parametrize("around", AROUND)
def test_classes_of_the_page_and_its_wrappers_say_nothing_of_the_article(chain, around):
    assert htmlpages.extract([around.format(ARTICLE)], chain) == [SAID]


def test_many_class_words_and_tags_cut_nothing_off(chain):
    deep = "".join(f"<{t}>" for t in ("main", "section", "div", "ul", "li", "blockquote", "figure", "details", "b"))
    page = f"<article>{deep}<div class='ad cookie comment sidebar menu footer top share login content'><p>Buy a thing, do.</p></div>" + ARTICLE
    assert "Buy a thing" not in htmlpages.extract([page], chain)[0]


@pytest.mark.parametrize("page", ["<a " * 400_000 + '"', "<![CDATA[>" * 100_000, "<script>" + "</script " * 120_000, "<p class='" * 100_000, "<a \"<b '" * 120_000, "<" * 1_000_000, "<!" * 500_000, "<style></style" * 80_000, "<i " * 300_000 + "'>"])
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    htmlpages.parse(page)
    assert time.process_time() - began < 4


def test_broken_tags():
    said = lambda page: " | ".join(b.text for b in htmlpages.parse(page))
    assert said("<p>a <a href='x>b</a> c") == "a b c" and said('<p title="a > b">x') == "x" and said("a < b <1 c") == "a < b <1 c"
    assert said("<p>x<script>if (a < b) { '</p>' }</script>y<style>z</style >w") == "xyw" and said("a<![CDATA[ b > c ]]>d<!-- e > f -->g<?h?>i<!j>k") == "adgik" and said("<p>a<b") == "a"


@pytest.mark.parametrize("seed", range(3))
def test_gradients(seed):
    rng = np.random.default_rng(seed)
    m = attention.fit_model([rng.integers(0, 50, 300) for _ in range(4)], 60, steps=0)
    for k in m.p:
        m.p[k] = rng.normal(0, 0.3, m.p[k].shape)
    c = rng.integers(0, attention.CLASSES, (2, attention.WINDOW + 2))
    _, d = m.gradients(c)
    for k, w in m.p.items():
        at = np.unravel_index(np.argmax(np.abs(d[k])), w.shape)
        ends = []
        for step in (1e-5, -2e-5, 1e-5):
            w[at] += step
            ends.append(m.gradients(c)[0])
        assert np.isclose((ends[0] - ends[1]) / 2e-5, d[k][at], rtol=1e-3)


def plain_score(m, text):
    """Place by place: the whole window again for each id, one softmax over all classes of a group, in double precision."""
    p = {k: w.astype(float) for k, w in m.p.items()}
    ids = [m.vocabulary, *map(int, text), m.vocabulary + 1]
    total, width, group = 0.0, attention.WIDTH, attention.GROUP
    for k in range(len(ids) - 1):  # ids[k + 1] is wanted
        later = max(0, -(-(k + 1 - attention.WINDOW) // attention.STRIDE))
        first = later * attention.STRIDE
        x = np.stack([p["here"][m.cls[ids[j]]] + p["before"][m.cls[ids[max(0, j - 1)]]] + p["place"][j - first] for j in range(first, k + 1)])
        e = np.exp((x @ p["k"]) @ (x[-1] @ p["q"]) / width**0.5)
        u = np.maximum(0, x[-1] @ p["x"] + (e / e.sum()) @ (x @ p["v"]) @ p["c"] + p["b"])
        prev, want = m.cls[ids[k]], m.cls[ids[k + 1]]
        g = u @ p["g"] + m.groups[prev]
        z = u @ p["m"][:, want // group * group : (want // group + 1) * group] + m.members[prev * (attention.CLASSES // group) + want // group]
        total += g[want // group] - np.log(np.exp(g).sum()) + z[want % group] - np.log(np.exp(z).sum()) + m.within[ids[k + 1]]
    return total / math.log(10)


def test_the_score_is_that_of_a_plain_loop():
    rng = np.random.default_rng(1)
    m = attention.fit_model([rng.integers(0, 5, 200) for _ in range(30)], 6, steps=40)
    for k in m.p:
        m.p[k] = (m.p[k] + rng.normal(0, 0.2, m.p[k].shape)).astype(np.float32)
    w, s = attention.WINDOW, attention.STRIDE
    texts = [rng.integers(0, 6, n) for n in (0, 1, 3, w - 2, w - 1, w, w + 1, w + s - 1, w + s, w + s + 1, 5 * w + 7)]
    want = [plain_score(m, t) for t in texts]
    assert np.allclose(m.score(texts), want, rtol=1e-4) and np.allclose([m.score([t])[0] for t in texts], want, rtol=1e-4)
    assert len(m.score([])) == 0


def test_a_place_is_looked_up_once(monkeypatch):
    """Though windows overlap by half, a text's inputs are not made anew for every window that it is in."""
    m = attention.fit_model([np.arange(6)], 6, steps=1)
    looked, rows = [], attention.AttentionModel._rows
    monkeypatch.setattr(attention.AttentionModel, "_rows", lambda self, name, table, at: (looked.append(at.size if table is self.p["here"] else 0), rows(self, name, table, at))[1])
    m.score([np.arange(100_000) % 6])
    assert 100_001 <= sum(looked) < 105_000


def test_scores_beyond_what_can_be_raised_stay_finite():
    """Weights of attention far from 0, and fewer windows than are worked on at once, or more."""
    rng = np.random.default_rng(4)
    m = attention.fit_model([rng.integers(0, 5, 200) for _ in range(30)], 6, steps=5)
    m.p["q"] *= 200
    m.p["k"] *= 200
    texts = [rng.integers(0, 6, n) for n in (0, 30, 24 * 130, 24 * 600 + 5)]
    got = m.score(texts)
    assert np.isfinite(got).all() and np.allclose(got, [m.score([t])[0] for t in texts], rtol=1e-4)


def test_the_model_is_a_distribution_and_causal():
    """The probabilities of all ids at a place sum to 1, and a place's do not depend on what comes after."""
    rng = np.random.default_rng(1)
    m = attention.fit_model([rng.integers(0, 5, 200) for _ in range(30)], 6, steps=20)
    u = rng.normal(size=(1, attention.HIDDEN)).astype(np.float32)
    total = sum(np.exp(m.log_probabilities(u, np.array([2]), np.array([c]))[0]) for c in range(attention.CLASSES))
    share = np.bincount(m.cls, weights=np.exp(m.within), minlength=attention.CLASSES)
    assert np.isclose(total, 1, atol=1e-4) and np.allclose(share[np.unique(m.cls)], 1)
    here = rng.integers(0, 6, (2, attention.WINDOW))
    here[1, :30] = here[0, :30]
    hidden = m._body(here, here, slice(0, attention.WINDOW))[-1].reshape(2, attention.WINDOW, -1)
    assert np.allclose(hidden[0, :30], hidden[1, :30], atol=1e-5) and not np.allclose(hidden[0, 30:], hidden[1, 30:], atol=1e-3)


def test_training_lowers_the_loss_on_texts_kept_apart():
    """Ids that follow what stood some places before, which counts of pairs cannot tell."""
    rng = np.random.default_rng(2)

    def text():
        key = rng.integers(0, 8)
        return np.array([x for _ in range(40) for x in (20 + key, 40 + rng.integers(0, 3), rng.integers(0, 8) if rng.random() < 0.1 else key)])

    texts, apart = [text() for _ in range(300)], [text() for _ in range(40)]
    start, after = (attention.fit_model(texts, 60, steps=n).score(apart).sum() for n in (0, 300))
    assert after > start * 0.9


def test_gradients_need_no_loss():
    rng = np.random.default_rng(6)
    m = attention.fit_model([rng.integers(0, 50, 300) for _ in range(4)], 60, steps=3)
    c = rng.integers(0, attention.CLASSES, (5, attention.WINDOW + 2))
    (loss, want), (none, got) = m.gradients(c), m.gradients(c, measured=False)
    assert loss > 0 and none == 0 and all(np.array_equal(want[k], got[k]) for k in m.p)


def test_windows_are_drawn_by_slices():
    """The windows of each document by itself, as one after the other gives them; a batch for many documents, not each."""
    rng = np.random.default_rng(7)
    texts = [rng.integers(0, 60, n).astype(np.uint16) for n in (0, 1, 2, 47, 48, 49, 95, 96, 97, 1000, *rng.integers(0, 300, 290))]
    want = []
    for t in texts:
        windows, rest = attention.cut_windows(attention.stream([t], 60))
        want += [w.astype(np.uint16).tobytes() for w in [*windows, *([attention.last_window(rest)[0]] if len(rest) > 2 else [])]]
    batch = pa.RecordBatch.from_arrays([pa.array([t.tobytes() for t in texts], pa.binary())], names=["ids"])
    for part in (1.0, 0.3):
        got = list(lm_score._drawn([batch], 60, part))
        assert len(got) == 1 and sorted(got[0].column(0).to_pylist()) == sorted(w for w in want if zlib.crc32(w) < part * 2.0**32)
    assert all(b.num_rows == 0 for b in lm_score._drawn([batch.slice(0, 1), batch.slice(0, 0)], 60, 1.0))


def test_word_ids_are_those_of_the_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    ids, hasher = lm_score.WordIds(P.path("piece_bpe_32k.model")), Hasher()
    texts = [t or "" for _, t in ROWS] + ["x" * 700 + " " + "y" * 513, "a▁b  ▁ c"]
    for _ in range(2):  # the second time from the cache
        for t, got in zip(texts, ids(words_of(texts, BLANK, hasher)), strict=True):
            assert got.tolist() == [i for w in re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOW)) for i in library.encode(w)]


def test_fingerprints():
    """Words that a polynomial modulo 2**64 cannot tell apart, and all lengths around those of eight bytes."""
    a = "".join("ab"[k.bit_count() % 2] for k in range(1024))
    texts = [a[:n] for n in (64, 256, 512, 1024)] + [a.translate({97: "b", 98: "a"})[:n] for n in (64, 256, 512, 1024)] + ["x" * n for n in (*range(1, 40), 511, 512, 513, 514)] + ["\0", "a\0"]
    got = words_of(texts, BLANK, Hasher())
    assert len(set(got.hashes.tolist())) == len(texts) and (got.hashes >= 0).all()
    again = words_of([" ".join(reversed(texts))], BLANK, Hasher()).hashes[::-1]
    assert (again == got.hashes).all()


def test_scores(odd, none, spark):
    path = P.path("piece_bpe_32k.model")
    words = re.compile(r"[^\x20\x09-\x0D]+")
    rows = [(k, " ".join(random.Random(k).choices(["the", "of", "Alpha", "beta", f"rare{k}"], k=40))) for k in range(60)] + [(i, t) for i, t in ROWS]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, base int").repartition(3)
    split = [(i, words.findall((t or "").translate(LOW)) + ["\0end"], i is not None and zlib.crc32(str(i).encode()) % 5 == 1) for i, t in rows]
    count = collections.Counter(w for _, ws, out in split if not out for w in ws)
    n, v = sum(count.values()), len(count)
    want = sorted((i or -1, out, len(ws), sum(w in count for w in ws), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws, out in split)
    got = lm_score.score_documents(df, path, steps=5).collect()
    assert sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm_score.score_documents(none, path, steps=5).count() == 0


def test_all_ids_are_learned_from(spark):
    """What stands only behind the first 20,000 ids of a document, or in one document of many, is learned."""
    rows = [(0, "alpha " * 21_000 + "zebra " * 9_000, True)] + [(k, "river " * 3, True) for k in range(1, 6_000)] + [(6_000, "zebra " * 40, False), (6_001, "giraffe " * 40, False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, learned boolean").repartition(4)
    got = {r.doc_id: r.score for r in lm_score.score_documents(df, P.path("piece_bpe_32k.model"), F.col("learned"), steps=20).where("doc_id >= 6000").collect()}
    assert got[6_000] > -60 and got[6_001] < 3 * got[6_000]


def test_scores_do_not_depend_on_how_rows_lie(spark):
    """The same rows in one partition, and in five in another order: the same scores but for single precision."""
    rng = np.random.default_rng(8)
    words = ["w" + "".join(rng.choice(list("abcdefgh"), 3)) for _ in range(200)]
    rows = [(k, " ".join(words[x] for x in rng.zipf(1.5, 60) % 200)) for k in range(300)]
    path, scores = P.path("piece_bpe_32k.model"), []
    for order, parts in ((rows, 1), ([rows[k] for k in rng.permutation(300)], 5)):
        df = spark.createDataFrame(order, "doc_id long, text string").repartition(parts)
        scores.append(np.array([r.score for r in lm_score.score_documents(df, path, steps=20).orderBy("doc_id").collect()]))
    assert np.allclose(*scores, rtol=1e-4)
