"""Main text of web pages: a conditional random field over the leaf blocks of the document tree.

parse() reads a page, however broken, into leaf blocks in page order: text between block-level tags, with the tags and
class words of its ancestors, without scripts, styles and comments.  Each character of a page is looked at a bounded
number of times.  Each block gets features of its ancestors, its text, and its place; the field labels blocks as article
or not, and Viterbi finds the likeliest labelling of the page.

What an ancestor's tag and class words say depends on where the article is.  Its likeliest container is found first:
the article element, else the main one, else that with a class word for content, else the parent of paragraphs, that
holds most text outside of menus, comments and the like.  The container and what it lies in (the body, wrappers, whose
classes describe the whole page) say nothing about a block; ancestors inside the container, and those beside it, do.

The field is fitted on labelled pages made by labelled_page() below: PAGES pages of many layouts with made-up words,
whose article blocks are known.  That number bounds the sample; no page of the input is needed for fitting.

Cases: null, empty or tag-free pages: text outside any tag is one block; pages without article text give an empty
string; a tag that never ends swallows the rest; a very long page is taken whole, in time that grows with its length; of
containers with equally much text the first counts; a null id or url and repeated rows give a row each; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from nearfold.llm.chain import ChainField, fit_chain
from nearfold.llm.texts import map_texts

#: Labelled pages that the field is fitted on.
PAGES = 500
EPOCHS, RATE, DECAY = 150, 0.1, 1e-3

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW = {t: re.compile(rf"</{t}\b", re.I) for t in ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "title", "select", "math", "object", "canvas")}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: What an opening tag closes, up to the given borders.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

_TAGS = "article main section div aside nav header footer form ul ol li table td th dl blockquote figure figcaption h1 h2 h3 h4 h5 h6 p pre button label address details a b".split()
#: Class and id words that speak for or against an article, by kind.
_HINTS = {
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion banner", "notice": "cookie cookies notice consent gdpr alert popup modal overlay message",
    "comments": "comment comments commentlist reply replies respond discussion disqus reviews", "side": "sidebar side widget widgets related recommended popular trending more aside rail",
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs pagination pager toc tabs skip", "foot": "footer foot copyright legal bottom colophon", "head": "header masthead top logo site-header branding topbar",
    "share": "share sharing social follow tags tagcloud meta byline author", "form": "form login signup subscribe newsletter search contact", "main": "content article post entry story main body text page-content post-content entry-content article-body prose",
}
_HINT_OF = {w: kind for kind, words in _HINTS.items() for w in words.split()}


#: Kinds of class words, and tags, whose text is not the article's, if they stand alone; first parts of class words that
#: say what a page has or lacks.
_AGAINST = {"ad", "notice", "comments", "side", "menu", "foot", "form"}
_BESIDE = {"nav", "aside", "footer", "form"}
_WITH = {"no", "has", "with", "without", "is", "not", "hide", "show", "toggle"}
_KNOWN = frozenset(_TAGS)
_NONE: frozenset[str] = frozenset()


@dataclass(slots=True, eq=False)
class Inside:
    """An open tag and, made from the one above it in constant space, what the features need of its path: no block holds
    as many entries as it is deep."""

    tag: str = ""
    hints: frozenset[str] = _NONE  # kinds of its own class words
    against: bool = False  # it or one above it is not the article's, by a class word that stands alone or its tag
    up: Inside | None = None
    number: int = 0
    tags: frozenset[str] = _NONE  # of the path, those in _TAGS
    articles: int = 0  # on the path
    parent: str = ""  # the innermost block-level tag
    body: bool = False  # named as the body of an article

    def within(self, number: int, tag: str, words: set[str]) -> Inside:
        """A tag below this one, of class words in lower case."""
        hints, alone = set(), False
        for w in words if tag not in ("body", "html") else ():
            parts = [x for x in re.split(r"[^a-z0-9]+", w) if x]
            if len(parts) > 1 and parts[0] in _WITH:
                continue
            hints |= {_HINT_OF[x] for x in parts if x in _HINT_OF}
            alone |= len(parts) == 1 and _HINT_OF.get(parts[0]) in _AGAINST
        tags = self.tags if tag in self.tags or tag not in _KNOWN else self.tags | {tag}
        return Inside(tag, frozenset(hints), self.against or alone or tag in _BESIDE, self, number, tags, self.articles + (tag == "article"), tag if tag in _BLOCK else self.parent, "articlebody" in words)


@dataclass
class Block:
    text: str
    inside: Inside
    linked: float  # share of the text inside links


class Tags:
    """Where the tags of a page end.  What was looked for in vain is not looked for again."""

    def __init__(self, page: str):
        self.page, self.none = page, set()
        self.ahead = (-1, -1)  # from the first on there is no stop before the second

    def _find(self, what: str, at: int) -> int:
        if what in self.none:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.none.add(what)
        return found

    def _stop(self, at: int) -> int:
        if not self.ahead[0] <= at <= self.ahead[1]:
            m = _STOP.search(self.page, at)
            self.ahead = (at, m.start() if m else len(self.page))
        return self.ahead[1]

    def end(self, at: int) -> int:
        """Of a tag: after the next > outside of quotes, a quote that is never closed being none; else of the page."""
        while (stop := self._stop(at)) < len(self.page) and self.page[stop] != ">":
            close = self._find(self.page[stop], stop + 1)
            at = close + 1 if close > 0 else stop + 1
        return min(stop + 1, len(self.page))

    def markup(self, at: int) -> int:
        """The end of a comment, a CDATA section or a declaration at `at`."""
        page = self.page
        if page.startswith("<!--", at):
            close = self._find("-->", at + 4)
            return close + 3 if close > 0 else len(page)
        close = self._find("]]>", at) if page.startswith("<![CDATA[", at) else -1
        if close > 0:
            return close + 3
        close = self._find(">", at)
        return close + 1 if close > 0 else len(page)


def parse(page: str) -> list[Block]:
    """The page's leaf blocks in order."""
    blocks: list[Block] = []
    stack: list[tuple[str, Inside]] = []
    root, made, tags = Inside(), 0, Tags(page)
    open_: Counter[str] = Counter()  # tags on the stack: what is not there is not looked for
    held: list[str] = []
    chars = linked = links = 0

    def flush() -> None:
        nonlocal chars, linked
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                blocks.append(Block(text, stack[-1][1] if stack else root, linked / max(1, chars)))
            held.clear()
        chars = linked = 0

    def add(text: str) -> None:
        nonlocal chars, linked
        if text:
            held.append(text)
            chars += len(text)
            linked += len(text) if links else 0

    def pop(to: int) -> None:
        nonlocal links
        for tag, _ in stack[to:]:
            open_[tag] -= 1
            links -= tag == "a"
        del stack[to:]

    at, size = 0, len(page)
    while at < size:
        cut = page.find("<", at)
        if cut < 0:
            add(page[at:])
            break
        add(page[at:cut])
        if page.startswith(("<!", "<?"), cut):
            at = tags.markup(cut)
            continue
        m = _NAME.match(page, cut + 1)
        if not m:
            add("<")
            at = cut + 1
            continue
        at = tags.end(m.end())
        tag, rest = m[2].lower(), page[m.end() : at - (page[at - 1] == ">")]
        if m[1]:
            if tag in _BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1) if open_[tag] else ():
                if stack[k][0] == tag:
                    pop(k)
                    break
                if tag not in _BLOCK and stack[k][0] in _BLOCK:
                    break
            continue
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            at = tags.end(end.end()) if end else size
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in _BLOCK:
            flush()
            for k in range(len(stack) - 1, -1, -1) if open_["p"] else ():  # a paragraph ends where a block begins
                if stack[k][0] == "p":
                    pop(k)
                    break
                if stack[k][0] in _BLOCK:
                    break
            if tag in _CLOSES:
                ends, border = _CLOSES[tag]
                for k in range(len(stack) - 1, -1, -1) if any(open_[t] for t in ends) else ():
                    if stack[k][0] in border:
                        break
                    if stack[k][0] in ends:
                        pop(k)
                        break
        if tag in _VOID or rest.endswith("/"):
            continue
        words: set[str] = set()
        if "=" in rest:
            for x in _ATTRIBUTE.finditer(rest):
                words |= set((x[2] or x[3] or x[4] or "").lower().split())
        made += 1
        stack.append((tag, (stack[-1][1] if stack else root).within(made, tag, words)))
        open_[tag] += 1
        links += tag == "a"
    flush()
    return blocks


_KINDS = [*(f"in {t}" for t in _TAGS), *(f"parent {t}" for t in _TAGS), *(f"hint {h}" for h in _HINTS), *(f"main hint over {h}" for h in _HINTS)]
_KINDS += [f"words {k}" for k in range(8)] + [f"linked {k}" for k in range(4)] + [f"place {k}" for k in range(5)] + [f"from end {k}" for k in range(5)]
_KINDS += ["bias", "copyright", "sentence", "one word", "article page", "article page, outside", "main page, outside", "first heading", "comment inside article", "bare body", "apart", "clean article", "apart in article", "clean main", "apart in main", "clean, no main", "alone"]
_NUMBER = {k: n for n, k in enumerate(_KINDS)}


def _paths(blocks: list[Block]) -> list[Inside]:
    """All tags that blocks lie in, those above others first."""
    found: dict[int, Inside] = {}
    for b in blocks:
        x = b.inside
        while x is not None and x.number not in found:
            found[x.number] = x
            x = x.up
    return [found[k] for k in sorted(found)]


def _container(blocks: list[Block], paths: list[Inside]) -> tuple[Inside | None, str]:
    """The likeliest container of the article, and its kind: article, main or neither."""
    weight: Counter[int] = Counter()  # text inside, links left out; little of it where it is not the article's
    direct: Counter[int] = Counter()  # the same in paragraphs right below
    by = {x.number: x for x in paths}
    titled = set()
    for b in blocks:
        own = len(b.text) * (1 - b.linked) * (0.1 if b.inside.against else 1)
        weight[b.inside.number] += own
        x = b.inside
        while x is not None and x.tag not in _BLOCK:
            x = x.up
        if x is not None and x.tag == "p" and x.up is not None:
            direct[x.up.number] += own
        if "h1" in b.inside.tags:
            titled.add(b.inside.number)
    for x in reversed(paths):
        if x.up is not None:
            weight[x.up.number] += weight[x.number]
            if x.number in titled:
                titled.add(x.up.number)
    for kind, of in (("article", lambda x: x.tag == "article" or x.body), ("main", lambda x: x.tag == "main"), ("main", lambda x: "main" in x.hints)):
        if some := [x for x in paths if of(x)]:
            return max(some, key=lambda x: (weight[x.number], -x.number)), kind
    if direct:
        return by[max(direct, key=lambda k: (direct[k] * (1 + (k in titled)), -k))], ""
    return None, ""


def features(blocks: list[Block]) -> list[list[int]]:
    """Feature numbers of each block."""
    out, n = [], len(blocks)
    paths = _paths(blocks)
    home, kind = _container(blocks, paths)
    holders, x = set(), home
    while x is not None:
        holders.add(x.number)
        x = x.up
    # of each path: kinds of class words and tags that are said of less than the whole article, and whether it is in there
    live, boxed, inner, main = {}, {}, {}, {}
    for x in paths:
        k, up = x.number, x.up.number if x.up is not None else -1
        held = k in holders or x.up is None or x.tag in ("body", "html")
        live[k] = _NONE if held else live[up] if x.hints <= live[up] else live[up] | x.hints
        boxed[k] = _NONE if held else boxed[up] if x.tag not in _KNOWN or x.tag in boxed[up] else boxed[up] | {x.tag}
        inner[k] = x is home or inner.get(up, False)
        main[k] = x.tag == "main" or "main" in x.hints or main.get(up, False)
    nested = home.articles if home is not None else 0
    for at, block in enumerate(blocks):
        b, text = block.inside, block.text
        hints = live[b.number]
        apart = bool(hints - {"main"}) or any(t in boxed[b.number] for t in ("nav", "aside", "footer", "form", "button", "label"))
        if inner[b.number] and kind:
            named = {f"apart in {kind}" if apart or b.articles > nested else f"clean {kind}"}
        elif b.articles:  # another article
            named = {"apart in article" if apart or b.articles > 1 else "clean article"}
        else:
            named = {"apart"} if apart else set() if kind else {"clean, no main"}
        own = named | {"bias", *(f"in {t}" for t in b.tags), *(f"hint {h}" for h in hints)}
        own.add(f"parent {b.parent}" if b.parent else "bare body")
        if main[b.number]:
            own |= {f"main hint over {h}" for h in hints}
        words = text.count(" ") + 1
        own.add(f"words {min(7, words.bit_length() - 1)}")
        own.add(f"linked {min(3, int(block.linked * 4))}")
        own.add(f"place {min(4, at * 5 // n)}")
        own.add(f"from end {min(4, n - 1 - at)}")
        if n == 1:
            own.add("alone")
        if words == 1:
            own.add("one word")
        if "©" in text or "copyright" in text.lower():
            own.add("copyright")
        if text[-1] in ".!?:;\"”" and words > 3:
            own.add("sentence")
        if kind == "article":
            own.add("article page" if inner[b.number] else "article page, outside")
        if kind == "main" and not inner[b.number]:
            own.add("main page, outside")
        if "h1" in b.tags:
            own.add("first heading")
        if "comments" in hints and b.articles:
            own.add("comment inside article")
        out.append(sorted(_NUMBER[x] for x in own if x in _NUMBER))
    return out


def _padded(rows: list[list[int]]) -> np.ndarray:
    """As an array; the number past the last feature stands for none."""
    out = np.full((len(rows), max(map(len, rows), default=0)), len(_KINDS), dtype=np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


# ---- labelled pages ----

_SYLLABLES = "ka ro mi ten sol va der lin po ra shu bel not gri an el to fa wi zem or is un che dal".split()


def labelled_page(rng: random.Random) -> tuple[str, str]:
    """A made-up page and its article text."""
    gold: list[str] = []

    def word() -> str:
        return "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 3)))

    def phrase(a: int, b: int) -> str:
        return " ".join(word() for _ in range(rng.randint(a, b)))

    def sentence(a: int = 3, b: int = 22) -> str:
        return phrase(a, b).capitalize() + rng.choice("...!?")

    def prose() -> str:
        return " ".join(sentence() for _ in range(rng.randint(1, 7)))

    def link(text: str) -> str:
        return f'<a href="/{word()}">{text}</a>'

    def menu(n: int) -> str:
        kind = rng.choice(["ul", "ul", "div"])
        item = "li" if kind == "ul" else "span"
        return f"<{kind}>" + " ".join(f"<{item}>{link(phrase(1, 2))}</{item}>" for _ in range(n)) + f"</{kind}>"

    def keep(tag: str, text: str, shown: str | None = None) -> str:
        gold.append(" ".join(text.split()))
        return f"<{tag}>{shown or text}" + ("" if tag == "p" and rng.random() < 0.1 else f"</{tag}>")

    def article() -> str:
        title = phrase(2, 9)
        parts = [keep("h1", title)] if rng.random() < 0.85 else []
        if parts and rng.random() < 0.2:
            parts = [f"<header>{parts[0]}</header>"]
        for _ in range(rng.choice([1, 1, 2, 3, 4, 6, 8, 11, 14])):
            kind = rng.random()
            if kind < 0.62:
                text = prose()
                shown = text
                if rng.random() < 0.2:
                    w = text.split(" ")
                    k = rng.randrange(len(w))
                    w[k] = rng.choice([link(w[k]), f"<b>{w[k]}</b>", f"<em>{w[k]}</em>"])
                    shown = " ".join(w)
                parts.append(keep("p", text, shown))
            elif kind < 0.70:
                text = phrase(1, 4)
                parts.append(keep("p", text))
            elif kind < 0.78:
                parts.append(keep(rng.choice(["h2", "h3"]), phrase(1, 6)))
            elif kind < 0.84:
                tag = rng.choice(["ul", "ol"])
                parts.append(f"<{tag}>" + "".join(keep("li", phrase(1, 12)) for _ in range(rng.randint(2, 5))) + f"</{tag}>")
            elif kind < 0.88:
                parts.append("<blockquote>" + keep("p", prose()) + "</blockquote>")
            elif kind < 0.91:
                parts.append("<table>" + "".join("<tr>" + "".join(keep("td", phrase(1, 3)) for _ in range(2)) + "</tr>" for _ in range(rng.randint(1, 3))) + "</table>")
            elif kind < 0.94:
                parts.append('<figure><img src="x.png">' + keep("figcaption", phrase(3, 10)) + "</figure>")
            elif kind < 0.97:
                parts.append(advert())
            else:
                parts.append(f'<div class="{rng.choice(["share", "social", "tags"])}">' + " ".join(link(word()) for _ in range(3)) + "</div>")
        return "".join(parts)

    def advert() -> str:
        cls = rng.choice(["ad", "ads", "advert", "sponsored", "banner", "promo"])
        tag = rng.choice(["div", "aside", "div"])
        return f'<{tag} {rng.choice(["class", "id"])}="{cls}">' + rng.choice([sentence(), f"<p>{prose()}</p>", link(phrase(2, 6))]) + f"</{tag}>"

    def comments() -> str:
        outer = rng.choice(['<section id="comments">', '<div class="comments">', '<ol class="commentlist">', '<div id="disqus" class="comment-list">', '<section class="reader-comments">'])
        one = rng.choice([("<li>", "</li>"), ('<article class="comment">', "</article>"), ('<div class="comment">', "</div>"), ("<div>", "</div>")])
        inner = "".join(f"{one[0]}<b>{word()}</b><p>{prose()}</p>{one[1]}" for _ in range(rng.randint(1, 5)))
        return outer + rng.choice(["", "<h3>Comments</h3>"]) + inner + f"</{re.match(r'<(\w+)', outer)[1]}>"

    def sidebar() -> str:
        outer = rng.choice(['<aside>', '<div class="sidebar">', '<aside class="widget">', '<div id="related">'])
        return outer + f"<h3>{phrase(1, 3)}</h3>" + rng.choice([menu(rng.randint(2, 6)), f"<p>{prose()}</p>", f"<p>{sentence()}</p>" + menu(3)]) + f"</{re.match(r'<(\w+)', outer)[1]}>"

    def notice() -> str:
        return f'<div class="{rng.choice(["cookie", "notice", "consent", "alert", "popup"])}"><p>{sentence()}</p>' + rng.choice(["", "<button>OK</button>"]) + "</div>"

    def form() -> str:
        cls = rng.choice(["", ' class="newsletter"', ' id="search"', ' class="login"'])
        return f"<form{cls}><label>{phrase(1, 3)}</label><input name=x> <p>{sentence()}</p><button>{word()}</button></form>"

    bare = 0.0 if rng.random() < 0.15 else 1.0  # some pages have the article and nothing else
    body: list[str] = []
    if rng.random() < 0.3 * bare:
        body.append(notice())
    if rng.random() < 0.5 * bare:
        top = rng.choice(["<header>", '<div class="header">', '<div id="masthead">'])
        body.append(top + rng.choice([link(phrase(1, 3)), f"<h2>{phrase(1, 4)}</h2>", f"<p>{sentence(2, 8)}</p>"]) + f"</{re.match(r'<(\w+)', top)[1]}>")
    if rng.random() < 0.85 * bare:
        nav = rng.choice(["<nav>", '<div class="menu">', '<div id="navbar">', '<nav class="breadcrumbs">', '<ul class="nav">'])
        body.append(nav + menu(rng.randint(2, 8)) + f"</{re.match(r'<(\w+)', nav)[1]}>")
    for make, p in ((advert, 0.5), (sidebar, 0.25), (form, 0.15), (notice, 0.1)):
        if rng.random() < p * bare:
            body.append(make())
    box = rng.choice(["<article>"] * 4 + [f'<article class="{rng.choice(["post share", "entry has-sidebar", "post type-post", "story promo-off", "top"])}">', '<article id="top">', '<div class="page-content right-sidebar"><article>', '<main class="top"><div class="widget-area-left"><article class="post">'] + ["<main>", "<main><article>", '<div class="content">', '<div id="post-content">', '<div class="entry">', '<section class="article-body">', '<div class="story"><article>', "<div>"])
    closing = "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", box)))
    inner = article()
    if rng.random() < 0.15:
        inner += comments()
    body.append(box + inner + closing)
    for make, p in ((advert, 0.2), (sidebar, 0.35), (comments, 0.35), (form, 0.2), (notice, 0.1)):
        if rng.random() < p * bare:
            body.append(make())
    if rng.random() < 0.85 * bare:
        foot = rng.choice(["<footer>", '<div class="footer">', '<div id="footer">', "<footer>"])
        text = rng.choice([f"&copy; {word()}.com &middot; {sentence()}", f"<p>&copy; {word()} {sentence()}</p>", menu(3), f"<p>{sentence()}</p>" + menu(2)])
        body.append(foot + text + f"</{re.match(r'<(\w+)', foot)[1]}>")
    wrapper = rng.choice([""] * 3 + ['<div class="wrapper">', '<div class="row no-sidebar">', '<div id="top">', '<div class="widget-area-left">', '<div class="container menu-open">', '<div class="site-header-fixed"><div class="page">'])
    around = "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", wrapper)))
    if wrapper:
        at = next(k for k, x in enumerate(body) if x.startswith(box))
        lo, hi = rng.choice([(at, at + 1), (0, len(body))])
        body[lo:hi] = [wrapper + "".join(body[lo:hi]) + around]
    outer = rng.choice(["<body>"] * 3 + [f'<body class="{c}">' for c in ("right-sidebar", "home page top", "single-post has-sidebar logged-in", "no-sidebar menu-closed", "search comments-open")] + ['<body id="top">'])
    head = f"<!DOCTYPE html><html><head><title>{phrase(1, 6)}</title><style>p{{margin:0}}</style></head>{outer}"
    return head + rng.choice(["", "\n", " "]).join(body) + "</body></html>", " ".join(gold)


def _truth(blocks: list[Block], gold: str) -> list[int]:
    """1 for the blocks that make up the article, which they do in order."""
    left, out = gold, []
    for b in blocks:
        own = left.startswith(b.text) and (len(left) == len(b.text) or left[len(b.text)] == " ")
        out.append(int(own))
        left = left[len(b.text) :].lstrip(" ") if own else left
    return out


def fit(pages: int = PAGES, seed: int = 5) -> ChainField:
    rng = random.Random(seed)
    ids, truth, count = [], [], []
    for _ in range(pages):
        page, gold = labelled_page(rng)
        blocks = parse(page)
        ids += features(blocks)
        truth += _truth(blocks, gold)
        count.append(len(blocks))
    return fit_chain(_padded(ids), np.r_[0, np.cumsum(count)], np.array(truth), len(_KINDS) + 1, EPOCHS, RATE, DECAY)


def extract(pages: list[str], chain: ChainField) -> list[str]:
    """The main text of each page."""
    parsed = [parse(p) for p in pages]
    full = [b for b in parsed if b]
    if not full:
        return [""] * len(pages)
    first = np.r_[0, np.cumsum([len(b) for b in full])]
    label = chain.viterbi(_padded([f for b in full for f in features(b)]), first)
    out, k = [], 0
    for blocks in parsed:
        out.append(" ".join(b.text for b, y in zip(blocks, label[first[k] : first[k] + len(blocks)], strict=True) if y) if blocks else "")
        k += bool(blocks)
    return out


def extract_pages(pages: DataFrame, chain: ChainField | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """`id_col`, `url_col`, text and n_chars for every row."""
    held = pages.sparkSession.sparkContext.broadcast(chain or fit())

    def make():
        def work(texts: list[str]):
            out = extract(texts, held.value)
            return out, [len(t) for t in out]

        return work

    return map_texts(pages, html_col, [id_col, url_col], [("text", T.StringType()), ("n_chars", T.LongType())], make)
