"""A linear-chain conditional random field over lines that are good or bad.

A line's features give the log odds of good; four weights score a line's label next to
that of the line before. Forward and backward messages are products of 2 x 2 matrices,
which are associative, so they are computed for all lines of many texts at once in
log(lines) steps. The first line of a text has a matrix of equal rows, which carries
nothing over from what stands before it; so texts need no separation.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of the features, then the intercept
    steps: np.ndarray  # 2 x 2: label before, label
    slope: float  # from a text's mean marginal to its score
    shift: float
    prior: float  # score of a text without lines


def _scaled(m: np.ndarray) -> np.ndarray:
    return m / m.max(axis=(1, 2), keepdims=True)


def _prefix(m: np.ndarray, longest: int) -> np.ndarray:
    """Products of each matrix with those before it, over at least `longest` of them."""
    out, d = m.copy(), 1
    while d < min(longest, len(m)):
        out[d:] = _scaled(out[:-d] @ out[d:])
        d *= 2
    return out


def marginals(odds: np.ndarray, steps: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each line the chance of good, and of each pair of labels with the line before (zeros for a text's first)."""
    n = len(odds)
    if not n:
        return np.zeros(0), np.zeros((0, 2, 2))
    sizes = np.diff(first)
    is_first = np.zeros(n, bool)
    is_first[first[:-1][sizes > 0]] = True
    own = np.exp(np.clip(np.stack([-odds, odds], axis=1) / 2, -20, 20))
    m = np.exp(steps)[None] * own[:, None, :]
    m[is_first] = own[is_first][:, None, :]
    m = _scaled(m)
    longest = int(sizes.max())
    alpha = _prefix(m, longest)[:, 0, :]
    # Backward: products of the matrices after a line, by the same scan over transposed, reversed ones.
    behind = np.concatenate([m[1:], np.ones((1, 2, 2))])[::-1].transpose(0, 2, 1)
    beta = _prefix(np.ascontiguousarray(behind), longest)[::-1].transpose(0, 2, 1).sum(axis=2)
    alpha /= alpha.sum(axis=1, keepdims=True)
    beta /= beta.sum(axis=1, keepdims=True)
    both = alpha * beta
    good = both[:, 1] / np.maximum(both.sum(axis=1), 1e-300)
    pairs = np.zeros((n, 2, 2))
    pairs[1:] = alpha[:-1, :, None] * m[1:] * beta[1:, None, :]
    pairs[is_first] = 0
    pairs /= np.maximum(pairs.sum(axis=(1, 2), keepdims=True), 1e-300)
    return good, pairs


def mean_by_length(good: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each text's mean chance of good, weighted by the lines' lengths; NaN without lines."""
    num = np.concatenate([[0], np.cumsum(good * length)])[first]
    den = np.concatenate([[0], np.cumsum(length)])[first]
    with np.errstate(invalid="ignore"):
        return np.diff(num) / np.diff(den)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def _odds(model_weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (x @ model_weights[:-1].astype(np.float32)).astype(float) + model_weights[-1]


def fit(x: np.ndarray, length: np.ndarray, first: np.ndarray, labels: np.ndarray, rounds: int = 150, decay: float = 1e-3) -> Model:
    """From texts with labels 0 or 1, which their lines take over. Texts count alike, whatever their number of lines.

    Without labelled lines of both kinds nothing is learnt, and all scores are the share of label 1, or 0.5 without any.
    """
    prior = float(np.clip((labels.sum() + 0.5) / (len(labels) + 1), 0, 1))
    weights, steps = np.zeros(x.shape[1] + 1, np.float32), np.zeros((2, 2))
    sizes = np.diff(first)
    filled = sizes > 0
    if not filled.any() or len(np.unique(labels[filled])) < 2:
        return Model(weights, steps, 0.0, float(_logit(np.array([prior]))[0]), prior)
    y = np.repeat(labels, sizes).astype(float)
    share = np.repeat(1 / np.maximum(sizes, 1), sizes) / filled.sum()
    inner = np.ones(len(y), bool)
    inner[first[:-1][filled]] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner].astype(int), y[inner].astype(int)), share[inner])
    theta = np.concatenate([weights, steps.ravel()]).astype(float)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        good, pairs = marginals(_odds(theta[:-4], x), theta[-4:].reshape(2, 2), first)
        off = share * (good - y)
        g = np.concatenate([off.astype(np.float32) @ x, [off.sum()], ((pairs * share[:, None, None]).sum(axis=0) - seen).ravel()])
        g += decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= 0.1 * (0.5 + 0.5 * np.cos(np.pi * t / rounds)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    good, _ = marginals(_odds(theta[:-4], x), theta[-4:].reshape(2, 2), first)
    z, target = _logit(mean_by_length(good, length, first)[filled]), labels[filled].astype(float)
    slope, shift = 1.0, 0.0
    for _ in range(30):  # Newton's steps of a logistic regression on one variable
        p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((target - p) * z).sum() - 1e-2 * (slope - 1), (target - p).sum()])
        h = np.array([[(w * z * z).sum() + 1e-2, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        slope, shift = slope + step[0], shift + step[1]
    return Model(theta[:-4].astype(np.float32), theta[-4:].reshape(2, 2), float(slope), float(shift), prior)


def scores(model: Model, x: np.ndarray, length: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's score and each line's chance of good."""
    good, _ = marginals(_odds(model.weights, x), model.steps, first)
    mean = mean_by_length(good, length, first)
    out = 1 / (1 + np.exp(-np.clip(model.slope * _logit(np.nan_to_num(mean, nan=0.5)) + model.shift, -30, 30)))
    return np.where(np.isnan(mean), model.prior, out), good
