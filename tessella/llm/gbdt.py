"""Gradient-boosted trees with monotonic constraints, in numpy.

Fitted on the driver from a bounded sample; scored by walking flattened node
arrays for a whole matrix at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """All trees in one set of arrays; a leaf has feature -1 and points at itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """x: rows by features.  A value goes left if it is at most the threshold."""
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root, dtype=np.int32)
            for _ in range(self.depth):
                go_left = x[rows, np.maximum(self.feature[at], 0)] <= self.threshold[at]
                at = np.where(go_left, self.left[at], self.right[at])
            total += self.value[at]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    monotone: dict[int, int] | None = None,
    rounds: int = 60,
    depth: int = 4,
    rate: float = 0.15,
    bins: int = 64,
    l2: float = 2.0,
    least: float = 8.0,
) -> Trees:
    """Logistic loss, second-order gains over quantile bins.

    monotone: feature -> +1 (the score must not fall as it grows) or -1.  A
    split that breaks its feature's direction isn't taken, and the middle of
    its two values bounds everything below it, so the whole model obeys.
    least: smallest sum of second derivatives in a child.
    """
    monotone = monotone or {}
    n, width = x.shape
    if not n or not 0 < y.sum() < n:  # nothing to tell apart
        none = np.zeros(0, np.int32)
        return Trees(none, np.zeros(0), none, none, np.zeros(0), none, depth, 0.0)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(width)], axis=1)
    slots = max(len(c) for c in cuts) + 1
    flat = binned + np.arange(width) * slots
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    margin = np.full(n, bias)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def new_leaf(v: float) -> int:
        me = len(feature)
        feature.append(-1)
        threshold.append(np.inf)
        left.append(me)
        right.append(me)
        value.append(rate * v)
        return me

    def weight(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + l2), low, high))

    def score(g, h, w):
        return -(g * w + 0.5 * (h + l2) * w * w)

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        g, h = grad[rows].sum(), hess[rows].sum()
        own = weight(g, h, low, high)
        if level == depth or h < 2 * least:
            return new_leaf(own)
        keys = flat[rows].ravel()
        gs = np.bincount(keys, np.repeat(grad[rows], width), width * slots).reshape(width, slots)
        hs = np.bincount(keys, np.repeat(hess[rows], width), width * slots).reshape(width, slots)
        gl, hl = np.cumsum(gs, 1)[:, :-1], np.cumsum(hs, 1)[:, :-1]
        gr, hr = g - gl, h - hl
        wl, wr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
        gain = score(gl, hl, wl) + score(gr, hr, wr) - score(g, h, own)
        gain[(hl < least) | (hr < least)] = -np.inf
        for j, sign in monotone.items():
            gain[j, sign * (wr[j] - wl[j]) < 0] = -np.inf
        j, b = np.unravel_index(np.argmax(gain), gain.shape)
        if not gain[j, b] > 1e-6:
            return new_leaf(own)
        me = new_leaf(own)
        sign, middle = monotone.get(int(j), 0), float(wl[j, b] + wr[j, b]) / 2
        goes = binned[rows, j] <= b
        feature[me], threshold[me] = int(j), float(cuts[j][b])
        left[me] = grow(rows[goes], level + 1, middle if sign < 0 else low, middle if sign > 0 else high)
        right[me] = grow(rows[~goes], level + 1, middle if sign > 0 else low, middle if sign < 0 else high)
        return me

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        roots.append(grow(np.arange(n), 0, -4.0, 4.0))
        only = Trees(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots[-1:]), depth, 0.0)
        margin += only.margin(x)
    as_int = lambda a: np.array(a, dtype=np.int32)
    return Trees(as_int(feature), np.array(threshold, dtype=float), as_int(left), as_int(right), np.array(value, dtype=float), as_int(roots), depth, bias)
