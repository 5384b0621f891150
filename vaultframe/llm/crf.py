"""Linear-chain conditional random fields in numpy, over many sequences at once.

Sequences are walked in step, longest first, so that every step is one small matrix operation over those that have not
ended; probabilities are scaled at each step. Time and memory are linear in the number of positions.
"""

from __future__ import annotations

import numpy as np


class Walk:
    """Places of positions when sequences are walked in step. offsets: of the sequences in the positions."""

    def __init__(self, offsets: np.ndarray):
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        self.n = int((lengths > 0).sum())
        self.order, starts = order[: self.n], offsets[:-1][order][: self.n]
        longest = int(lengths[0]) if self.n else 0
        self.active = np.searchsorted(-lengths[: self.n], -np.arange(longest), "left")
        self.begin = np.concatenate(([0], np.cumsum(self.active)))
        total = int(self.begin[-1])
        step = np.repeat(np.arange(longest), self.active)
        self.places = starts[np.arange(total) - self.begin[step]] + step


def walk(emissions: np.ndarray, offsets: np.ndarray, start: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """Marginals of every position, by forward-backward; with pairs also their sums (log-likelihood of nothing observed is not kept). All scores are logarithms."""
    w, k = Walk(offsets), emissions.shape[1]
    e = emissions[w.places]
    e = np.exp(e - e.max(1, keepdims=True), dtype=np.float32) if len(e) else e
    a, first = np.exp(trans).astype(np.float32), np.exp(start - start.max()).astype(np.float32)
    alpha = np.empty((len(e), k), np.float32)
    b, steps = w.begin.tolist(), len(w.active)
    now = None
    for t in range(steps):
        part = e[b[t] : b[t + 1]]
        now = part * first if t == 0 else (now[: len(part)] @ a) * part
        now /= now.sum(1, keepdims=True)
        alpha[b[t] : b[t + 1]] = now
    beta, sums = np.ones((w.n, k), np.float32), np.zeros((k, k))
    back = a.T.copy()
    for t in range(steps - 1, -1, -1):
        here = alpha[b[t] : b[t + 1]]
        if t + 1 < steps:
            n = b[t + 2] - b[t + 1]
            onward = e[b[t + 1] : b[t + 2]] * beta[:n]
            if pairs:
                joint = here[:n, :, None] * a[None] * onward[:, None, :]
                sums += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            onward = onward @ back
            onward /= onward.sum(1, keepdims=True)
            beta[:n] = onward
        here *= beta[: len(here)]
    alpha /= alpha.sum(1, keepdims=True)
    out = np.empty_like(alpha)
    out[w.places] = alpha
    return (out, sums) if pairs else out


def gold_pairs(states: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    inner = np.ones(len(states), bool)
    inner[offsets[:-1][np.diff(offsets) > 0]] = False
    at = np.flatnonzero(inner)
    return np.bincount(states[at - 1] * k + states[at], minlength=k * k).reshape(k, k).astype(float)


class Adam:
    def __init__(self, *params: np.ndarray, rate: float = 0.05):
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, *grads: np.ndarray) -> None:
        """Moves the parameters uphill."""
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)


def sums_by(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between offsets; 0 where empty."""
    total = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, 0, dtype=np.float64)))
    return total[offsets[1:]] - total[offsets[:-1]]
