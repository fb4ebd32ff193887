"""A linear-chain conditional random field with two labels and sparse binary features, over many chains at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class ChainField:
    weights: np.ndarray  # of each feature, for label 1 against label 0; the last one pads and stays 0
    turn: np.ndarray  # 2 x 2 log potentials of (label before, label)
    begin: np.ndarray  # log potentials of the first place's label

    def _emit(self, ids: np.ndarray) -> np.ndarray:
        emit = np.zeros((len(ids), 2))
        emit[:, 1] = np.clip(self.weights[ids].sum(axis=1), -30, 30)
        return emit

    def marginals(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By forward-backward: P(label) of each place (places x 2), expected transitions (2 x 2), and P(label) of the
        first places, summed.  ids: features of each place; first: bounds of the chains, none of them empty."""
        emit = self._emit(ids)
        begins, live = _steps(first)
        local = np.exp(emit - emit.max(axis=1, keepdims=True))
        turn, begin = np.exp(self.turn), np.exp(self.begin)
        ahead, back = np.empty_like(local), np.ones_like(local)
        for t, n in enumerate(live):
            at = begins[:n] + t
            p = local[at] * (begin if t == 0 else ahead[at - 1] @ turn)
            ahead[at] = p / p.sum(axis=1, keepdims=True)
        moved = np.zeros((2, 2))
        for t in range(len(live) - 1, 0, -1):
            at = begins[: live[t]] + t
            inner = local[at] * back[at]
            joint = ahead[at - 1][:, :, None] * turn[None] * inner[:, None, :]
            moved += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            p = inner @ turn.T
            back[at - 1] = p / p.sum(axis=1, keepdims=True)
        post = ahead * back
        post /= post.sum(axis=1, keepdims=True)
        return post, moved, post[first[:-1]].sum(axis=0)

    def viterbi(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The likeliest labels of each chain; 1 wins ties."""
        emit = self._emit(ids)
        begins, live = _steps(first)
        best, came = np.empty_like(emit), np.zeros((len(ids), 2), dtype=np.int8)
        for t, n in enumerate(live):
            at = begins[:n] + t
            if t == 0:
                best[at] = emit[at] + self.begin
                continue
            options = best[at - 1][:, :, None] + self.turn[None]
            came[at] = options[:, 1] >= options[:, 0]
            best[at] = emit[at] + options.max(axis=1)
        label = (best[:, 1] >= best[:, 0]).astype(np.int8)
        for t in range(len(live) - 1, 0, -1):
            at = begins[: live[t]] + t
            label[at - 1] = came[at, label[at]]
        return label


def _steps(first: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Begins of the chains, longest first, and how many chains reach each step."""
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    begins, count = first[:-1][order], count[order]
    steps = int(count[0]) if len(count) else 0
    return begins, np.searchsorted(-count, -np.arange(steps), side="left").tolist()


def fit_chain(ids: np.ndarray, first: np.ndarray, truth: np.ndarray, features: int, epochs: int, rate: float, decay: float) -> ChainField:
    """Maximum conditional likelihood by Adam steps over all chains; the last of `features` is the padding."""
    field = ChainField(np.zeros(features), np.zeros((2, 2)), np.zeros(2))
    truth = truth.astype(np.int64)
    flat = ids.ravel()
    weight = np.bincount(flat, weights=np.repeat(truth, ids.shape[1]), minlength=features)
    inner = np.ones(len(truth), dtype=bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    moves = np.bincount(truth[at - 1] * 2 + truth[at], minlength=4).reshape(2, 2).astype(float)
    starts = np.bincount(truth[first[:-1]], minlength=2).astype(float)
    n = len(first) - 1
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (field.weights, field.turn, field.begin)]
    for step in range(1, epochs + 1):
        post, moved, begun = field.marginals(ids, first)
        expected = np.bincount(flat, weights=np.repeat(post[:, 1], ids.shape[1]), minlength=features)
        for (m, v), x, g in zip(state, (field.weights, field.turn, field.begin), (weight - expected, moves - moved, starts - begun), strict=True):
            g = g / n - decay * x
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        field.weights[-1] = 0
    return field
