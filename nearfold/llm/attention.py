"""A small causal self-attention language model in numpy: forward pass, gradients, training.

An input is the class of a subword id: the most frequent ids have a class each, the rest share the last.  At each place
of a window the model adds embeddings of the class here, of the class before, and of the place; attends to all places
up to this one; and predicts the next class in two softmaxes, over groups of GROUP classes and within the group, each
starting from the logarithms of bigram frequencies.  The last class's probability is dealt to its ids by frequency.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WINDOW, STRIDE = 48, 24
CLASSES, GROUP = 1024, 32
WIDTH, HIDDEN = 16, 32
STEPS, BATCH, RATE = 450, 384, 0.01
#: Blocks of STRIDE places that are scored at once, and of them those whose hidden values are made at once.
SCORED, SEEN = 512, 128
#: Rows of thin matrices that are multiplied at once.
ROWS = 384
_SEEN = np.tri(WINDOW, dtype=np.float32)
_MOST = np.where(_SEEN > 0, np.float32(60), np.float32(-np.inf))
_ONES = np.ones(GROUP, dtype=np.float32)


@dataclass
class AttentionModel:
    cls: np.ndarray  # class of each id; two ids more than the vocabulary has, for begin and end
    within: np.ndarray  # natural log of each id's share of its class
    p: dict[str, np.ndarray]
    groups: np.ndarray  # bigram log potentials, class x groups
    members: np.ndarray  # (class x groups) x members of the group

    def __post_init__(self):
        self.vocabulary = len(self.cls) - 2
        self._space: dict[str, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_space": {}}

    def _room(self, name: str, *shape: int) -> np.ndarray:
        """An array whose memory is used again by the next call of that name; values are left as they are."""
        size, kind = int(np.prod(shape)), self.p["q"].dtype
        held = self._space.get(name)
        if held is None or held.size < size or held.dtype != kind:
            held = self._space[name] = np.empty(size, dtype=kind)
        return held[:size].reshape(shape)

    def _rows(self, name: str, table: np.ndarray, at: np.ndarray) -> np.ndarray:
        if table.dtype != self.p["q"].dtype:
            return table.take(at, axis=0).astype(self.p["q"].dtype)
        return table.take(at, axis=0, out=self._room(name, *at.shape, table.shape[1]), mode="clip")

    def _product(self, name: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = self._room(name, *a.shape[:-1], b.shape[-1])
        if b.ndim > 2 or not a.flags.c_contiguous:
            return np.matmul(a, b, out=out)
        flat, into = a.reshape(-1, a.shape[-1]), out.reshape(-1, b.shape[1])
        cut = len(flat) - len(flat) % ROWS  # matrices so thin are faster multiplied by some hundred rows
        np.matmul(flat[:cut].reshape(-1, ROWS, a.shape[-1]), b, out=into[:cut].reshape(-1, ROWS, b.shape[1]))
        np.matmul(flat[cut:], b, out=into[cut:])
        return out

    def _joint(self) -> tuple[np.ndarray, np.ndarray]:
        """Queries times keys, and values times what is made of them: so scores and hidden values come from the inputs
        themselves, and no place's key or value is ever needed."""
        p = self.p
        return (p["q"] @ p["k"].T) * p["q"].dtype.type(WIDTH**-0.5), p["v"] @ p["c"]

    def _body(self, here: np.ndarray, before: np.ndarray, places: slice) -> tuple:
        """here, before: windows x WINDOW classes; hidden values for `places` only, which see all places up to theirs.
        e: weights before they are divided by their row sums s; as many more rows in each window are left to the gradients."""
        p, n, m = self.p, len(here), len(range(*places.indices(WINDOW)))
        x = self._rows("x", p["here"], here)
        x += self._rows("before", p["before"], before)
        x += p["place"]
        own = self._room("own", n, m, 2 * WIDTH)
        own[:, :, :WIDTH] = x[:, places]
        e, u = self._room("e", n, 2 * m, WINDOW), self._room("u", n * m, HIDDEN)
        q, s = self._attend(x, own, places, e[:, :m], u)
        return own, q, e, s, x, u

    def _attend(self, x: np.ndarray, own: np.ndarray, places: slice, e: np.ndarray, u: np.ndarray, opens: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """x: inputs of whole windows; own: those of `places`, and beside each the room for the mean input seen.  Sets
        those means, e to the weights and u to the hidden values; gives the queries, and the row sums of e.  opens:
        windows whose first half is not to be seen."""
        p, (asked, told), flat = self.p, self._joint(), own.reshape(-1, 2 * WIDTH)
        q = self._room("q", *own.shape[:2], WIDTH)
        np.matmul(flat[:, :WIDTH], asked, out=q.reshape(-1, WIDTH))
        np.matmul(q, x.transpose(0, 2, 1), out=e)
        if e.size and e.min() < -60:
            np.maximum(e, -60, out=e)
        np.minimum(e, _MOST[places], out=e)  # within 60 of 0, no row needs its maximum taken off
        np.exp(e, out=e)
        if opens is not None:
            e[opens, :, :STRIDE] = 0
        s = (e.reshape(-1, WINDOW) @ _SEEN[-1]).reshape(*e.shape[:2], 1)
        np.divide(self._product("c", e, x), s, out=own[:, :, WIDTH:])
        np.matmul(flat, np.concatenate([p["x"], told]), out=u)  # one product of twice the width is faster than two
        long_ = u.reshape(-1, own.shape[1] * HIDDEN)  # whole windows: with long rows, and not one number, all goes faster
        long_ += np.tile(p["b"], own.shape[1])
        np.maximum(long_, np.zeros(long_.shape[1], dtype=u.dtype), out=long_)
        return q, s

    def _logits(self, u: np.ndarray, here: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, np.ndarray]]]:
        """Logits of all groups, and of the members of each row's own; rows come sorted by group.  Of each group that has
        any: its rows, from and to, its number and its matrix."""
        g = self._product("g", u, self.p["g"])
        g += self._rows("groups", self.groups, here)
        cut = np.searchsorted(group, np.arange(CLASSES // GROUP + 1)).tolist()
        each = np.ascontiguousarray(self.p["m"].reshape(HIDDEN, -1, GROUP).transpose(1, 0, 2))
        parts = [(a, b, k, each[k]) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
        m = self._room("m", len(u), GROUP)
        for a, b, _, w in parts:
            np.matmul(u[a:b], w, out=m[a:b])
        m += self._rows("members", self.members, here * (CLASSES // GROUP) + group)
        return np.clip(g, -60, 60, out=g), np.clip(m, -60, 60, out=m), parts

    def log_probabilities(self, u: np.ndarray, here: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Natural logs of P(wanted class) for rows of u; a wanted class below 0 is none, and its log 0."""
        order = np.argsort((wanted // GROUP).astype(np.int8), kind="stable")
        order = order[np.count_nonzero(wanted < 0) :]
        kept = wanted[order]
        group = kept // GROUP
        g, m, _ = self._logits(self._rows("sorted", u, order), here[order], group)
        row = np.arange(len(order)) * GROUP
        got = g.ravel()[row + group].astype(np.float64) + m.ravel()[row + kept % GROUP]
        got -= np.log(np.exp(g, out=g) @ _ONES)
        got -= np.log(np.exp(m, out=m) @ _ONES)
        out = np.zeros(len(wanted))
        out[order] = got
        return out

    def _hidden(self, here: np.ndarray, before: np.ndarray, opens: np.ndarray, u: np.ndarray) -> None:
        """Sets u to the hidden values of blocks of STRIDE places, rows 1 and on of here and before (their classes), each
        as the second half of a window whose first half is the row above; those that open a text as a first half."""
        p, n = self.p, len(here) - 1
        one = self._rows("one", p["here"], here)
        one += self._rows("before", p["before"], before)
        x = self._room("x", n, WINDOW, WIDTH)
        np.add(one[:-1], p["place"][:STRIDE], out=x[:, :STRIDE])
        np.add(one[1:], p["place"][STRIDE:], out=x[:, STRIDE:])
        x[opens, STRIDE:] = one[opens + 1] + p["place"][:STRIDE]
        own = self._room("own", n, STRIDE, 2 * WIDTH)
        own[:, :, :WIDTH] = x[:, STRIDE:]
        self._attend(x, own, slice(STRIDE, WINDOW), self._room("e", n, STRIDE, WINDOW), u, opens)

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each text's ids followed by the end.  The first window of a text predicts all its places;
        each later one begins STRIDE places, half a window, further on and predicts its last STRIDE places, the ones not
        yet predicted.  So a block of STRIDE places sees itself and the block before it."""
        begin, end = self.vocabulary, self.vocabulary + 1
        n = np.array([len(t) + 1 for t in texts], dtype=np.int64)  # predictions of each text
        if not len(n):
            return np.zeros(0)
        ids = np.concatenate([x for t in texts for x in ([begin], t, [end])]).astype(np.int64)
        cls, within = self.cls[ids], self.within[ids]
        start = np.r_[0, np.cumsum(n + 1)][:-1]
        blocks = -(-n // STRIDE)
        text, opening = np.repeat(np.arange(len(texts)), blocks), np.cumsum(blocks) - blocks
        at = (np.arange(len(text)) - opening[text]) * STRIDE
        total = np.zeros(len(texts))
        for a in range(0, len(text), SCORED):
            b = min(a + SCORED, len(text))
            rows = np.maximum(np.arange(a - 1, b), 0)  # the blocks, and the one before them
            place = at[rows][:, None] + np.arange(STRIDE)
            last, from_ = (n[text[rows]] - 1)[:, None], start[text[rows]][:, None]
            inside = from_ + np.minimum(place, last)
            here, before = cls[inside], cls[np.maximum(inside - 1, from_)]
            u = self._room("hidden", (b - a) * STRIDE, HIDDEN)
            for c in range(a, b, SEEN):
                d = min(c + SEEN, b)
                opens = opening[np.searchsorted(opening, c) : np.searchsorted(opening, d)] - c
                self._hidden(here[c - a : d - a + 1], before[c - a : d - a + 1], opens, u[(c - a) * STRIDE : (d - a) * STRIDE])
            next_, real = (inside[1:] + 1).ravel(), (place <= last)[1:].ravel()
            got = self.log_probabilities(u, here[1:].ravel(), np.where(real, cls[next_], -1)) + within[next_] * real
            total += np.bincount(np.repeat(text[a:b], STRIDE), weights=got, minlength=len(texts))
        return total / np.log(10)

    def gradients(self, c: np.ndarray, measured: bool = True) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all places of all windows, and its gradients; a loss that is not `measured` is 0.
        c: windows x (WINDOW + 2) classes, the first of which is only seen as the one before."""
        p, kind = self.p, self.p["q"].dtype
        here = c[:, 1:-1]
        own, q, weights, s, x, u = self._body(here, c[:, :-2], slice(0, WINDOW))
        wanted = c[:, 2:].ravel()
        n, one = len(wanted), kind.type(1 / len(wanted))
        order = np.argsort((wanted // GROUP).astype(np.uint8), kind="stable")
        wanted, u_, row = wanted[order], self._rows("sorted", u, order), np.arange(n) * GROUP
        group = wanted // GROUP
        g, m, parts = self._logits(u_, here.ravel()[order], group)
        loss, d = 0.0, {"m": np.zeros_like(p["m"])}
        for z, hit in ((g, row + group), (m, row + wanted % GROUP)):
            flat = z.reshape(-1)
            loss -= flat[hit].sum() if measured else 0
            total = np.exp(z, out=z) @ _ONES
            loss += np.log(total).sum() if measured else 0
            z *= (one / total)[:, None]
            flat[hit] -= one
        d["g"] = u_.T @ g
        du_ = np.matmul(g, p["g"].T, out=self._room("of sorted", n, HIDDEN))
        for a, b, k, w in parts:
            d["m"][:, k * GROUP : (k + 1) * GROUP] = u_[a:b].T @ m[a:b]
            du_[a:b] += m[a:b] @ w.T
        du_ *= u_ > 0
        back = np.empty(n, dtype=np.intp)
        back[order] = np.arange(n)
        du = self._rows("of u", du_, back)
        two = lambda z: z.reshape(-1, z.shape[-1])
        (asked, told), scale = self._joint(), kind.type(WIDTH**-0.5)
        d["b"], both = np.ones(n, dtype=kind) @ du, two(own).T @ du
        d["x"], d_told = both[:WIDTH], both[WIDTH:]
        d["v"], d["c"] = d_told @ p["c"].T, p["v"].T @ d_told
        d_own = np.matmul(du, np.concatenate([p["x"], told]).T, out=self._room("of own", n, 2 * WIDTH)).reshape(own.shape)
        mix = self._room("mix", len(c), 2 * WINDOW, WIDTH)  # gradients of the mean inputs, then the queries
        dc, mix[:, WINDOW:] = mix[:, :WINDOW], q
        np.divide(d_own[:, :, WIDTH:], s, out=dc)
        e, de = weights[:, :WINDOW], weights[:, WINDOW:]
        np.matmul(dc, x.transpose(0, 2, 1), out=de)
        de -= np.multiply(dc, own[:, :, WIDTH:], out=self._room("c", *q.shape)) @ np.ones((WIDTH, 1), dtype=kind)
        de *= e
        dq = np.matmul(de, x, out=self._room("of q", *q.shape))
        d_asked = (two(x).T @ two(dq)) * scale
        d["q"], d["k"] = d_asked @ p["k"], d_asked.T @ p["q"]
        dx = np.matmul(weights.transpose(0, 2, 1), mix, out=self._room("of x", *x.shape))
        dx += d_own[:, :, :WIDTH]
        dx += np.matmul(two(dq), asked.T, out=self._room("of asked", n, WIDTH)).reshape(dx.shape)
        d["place"] = dx.sum(axis=0)
        both = self._room("both", len(c), WINDOW + 1, 2 * WIDTH)  # what each place gives its class here, and that of the place after it
        both[:, 0, :WIDTH] = both[:, WINDOW, WIDTH:] = 0
        both[:, 1:, :WIDTH] = both[:, :-1, WIDTH:] = dx
        order = np.argsort(c[:, :-1].astype(np.uint16), axis=None, kind="stable")
        values = c[:, :-1].ravel()[order]
        first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        pairs = two(self._rows("ordered", two(both), order)).view(np.result_type(dx, 1j))  # a complex sum is two sums at once
        sums = np.add.reduceat(pairs, first, axis=0).view(dx.dtype)
        for name, columns in (("here", slice(0, WIDTH)), ("before", slice(WIDTH, None))):
            d[name] = np.zeros_like(p[name])
            d[name][values[first]] = sums[:, columns]
        return loss / n, d


def stream(texts: list[np.ndarray], vocabulary: int) -> np.ndarray:
    """The ids of texts one after the other, each between begin and end."""
    return np.concatenate([x for t in texts for x in ([vocabulary], t, [vocabulary + 1])] or [np.array([vocabulary, vocabulary + 1])]).astype(np.int64)


def classes_of(have: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each id, and the natural log of its share of the class, by the counts of all ids."""
    cls = np.full(len(have), CLASSES - 1, dtype=np.intp)
    order = np.argsort(-have, kind="stable")[: CLASSES - 1]
    order = order[have[order] > 0]
    cls[order] = np.arange(len(order))  # frequent classes share groups, so that most tokens need few of them
    share = have + 0.5
    return cls, np.log(share / np.bincount(cls, weights=share, minlength=CLASSES)[cls])


def pairs_of(ids: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """The cells, class * CLASSES + next class, of a stream; nothing follows an end."""
    c = cls[ids].astype(np.int64)
    inner = np.flatnonzero(ids[:-1] != len(cls) - 1)
    return c[inner] * CLASSES + c[inner + 1]


def start_model(cls: np.ndarray, within: np.ndarray, pairs: np.ndarray, rng: np.random.Generator) -> AttentionModel:
    """The model before training: what the counts of the cells of pairs_of say."""
    pairs = pairs.reshape(CLASSES, CLASSES).astype(float)
    plain = pairs.sum(axis=0) + 0.1
    plain /= plain.sum()
    joint = (pairs + 20 * plain) / (pairs.sum(axis=1, keepdims=True) + 20)
    group = joint.reshape(CLASSES, -1, GROUP).sum(axis=2)
    shape = {"here": (CLASSES, WIDTH), "before": (CLASSES, WIDTH), "place": (WINDOW, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "x": (WIDTH, HIDDEN), "c": (WIDTH, HIDDEN), "b": (HIDDEN,), "g": (HIDDEN, CLASSES // GROUP), "m": (HIDDEN, CLASSES)}
    p = {name: (rng.normal(0, {"g": 0, "m": 0, "b": 0}.get(name, s[0] ** -0.5 if len(s) > 1 and s[0] <= HIDDEN else 0.3), s)).astype(np.float32) for name, s in shape.items()}
    return AttentionModel(cls, within, p, np.log(group).astype(np.float32), np.log(joint).astype(np.float32).reshape(-1, GROUP))


class Descent:
    """Adam on the model's own parameters."""

    def __init__(self, model: AttentionModel):
        self.model, self.steps = model, 0
        self.first, self.second = ({name: np.zeros_like(w) for name, w in model.p.items()} for _ in range(2))

    def learn(self, c: np.ndarray, rate: float) -> None:
        """c: windows of WINDOW + 2 classes."""
        _, d = self.model.gradients(c, measured=False)
        self.steps += 1
        step, scale = np.float32(rate / (1 - 0.9**self.steps)), np.float32((1 - 0.99**self.steps) ** -0.5)
        for name, w in self.model.p.items():
            first, second, g = self.first[name], self.second[name], d[name]
            first += np.float32(0.1) * (g - first)
            g *= g
            second += np.float32(0.01) * (g - second)
            w -= step * first / (np.sqrt(second) * scale + np.float32(1e-8))


def cut_windows(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of WINDOW + 2 ids that lie side by side, so that each id but the first two is wanted once, and what
    is left of the stream for the next call."""
    n = max(0, (len(ids) - 2) // WINDOW)
    return ids[np.arange(n)[:, None] * WINDOW + np.arange(WINDOW + 2)], ids[n * WINDOW :]


def last_window(ids: np.ndarray) -> np.ndarray:
    """The window for what cut_windows leaves at the end of a stream: it goes round."""
    return np.resize(ids, WINDOW + 2)[None, :]


def warm_up(model: AttentionModel, windows: np.ndarray, steps: int, rng: np.random.Generator) -> None:
    descent = Descent(model)
    for step in range(1, steps + 1 if len(windows) else 1):
        descent.learn(model.cls[windows[rng.integers(0, len(windows), BATCH)]], RATE * min(1.0, step / 50) * (1 - 0.95 * step / steps))


def fit_model(texts: list[np.ndarray], vocabulary: int, steps: int = STEPS, seed: int = 3) -> AttentionModel:
    """Fitted on the ids of texts that are all at hand; without any text, a uniform model."""
    ids = stream(texts, vocabulary)
    cls, within = classes_of(np.bincount(ids, minlength=vocabulary + 2))
    rng = np.random.default_rng(seed)
    model = start_model(cls, within, np.bincount(pairs_of(ids, cls), minlength=CLASSES * CLASSES), rng)
    starts = max(0, len(ids) - WINDOW - 1)
    if texts and starts:
        warm_up(model, ids[np.arange(starts)[:, None] + np.arange(WINDOW + 2)], steps, rng)
    return model
