"""A linear-chain conditional random field of two labels over chains of feature rows, vectorised over chains."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Crf:
    """emit: (features, 2) weights; step: (2, 2) scores from label to label."""

    emit: np.ndarray
    step: np.ndarray


def _grid(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chains by falling length: their first rows, and how many reach each position."""
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    reach = np.searchsorted(-lengths[order], -np.arange(1, (lengths.max(initial=0)) + 1), side="right")
    return starts, reach


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis, keepdims=True))).squeeze(axis)


def forward_backward(crf: Crf, x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of each row's labels, expected counts of each step, and the log of the chains' normalisers, summed."""
    scores = x @ crf.emit
    starts, reach = _grid(lengths)
    ahead, back, n = scores.copy(), np.zeros_like(scores), len(reach)
    for t in range(1, n):
        rows = starts[: reach[t]] + t
        ahead[rows] += _log_sum(ahead[rows - 1][:, :, None] + crf.step, 1)
    for t in range(n - 1, 0, -1):
        rows = starts[: reach[t]] + t
        back[rows - 1] = _log_sum((back[rows] + scores[rows])[:, None, :] + crf.step, 2)
    both = ahead + back
    norm = _log_sum(both, 1)
    steps = np.zeros((2, 2))
    inner = np.ones(len(x), bool)
    inner[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
    at = np.flatnonzero(inner)
    if len(at):
        pair = ahead[at - 1][:, :, None] + crf.step + (back[at] + scores[at])[:, None, :]
        steps = np.exp(pair - norm[at][:, None, None]).sum(0)
    return np.exp(both - norm[:, None]), steps, float(norm[(np.cumsum(lengths) - 1)[lengths > 0]].sum())


def viterbi(crf: Crf, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The likeliest labels of each chain; ties go to label 0."""
    best = x @ crf.emit
    come = np.zeros(best.shape, np.int8)
    starts, reach = _grid(lengths)
    for t in range(1, len(reach)):
        rows = starts[: reach[t]] + t
        ways = best[rows - 1][:, :, None] + crf.step
        come[rows] = ways.argmax(1)
        best[rows] += ways.max(1)
    labels = best.argmax(1)
    for t in range(len(reach) - 1, 0, -1):
        rows = starts[: reach[t]] + t
        labels[rows - 1] = come[rows, labels[rows]]
    return labels


def train(x: np.ndarray, lengths: np.ndarray, labels: np.ndarray, weights: np.ndarray, rounds: int = 150, decay: float = 1e-3, rate: float = 0.1) -> Crf:
    """Weights of (nearly) greatest penalised likelihood, by Adam over all chains; each row counts by its weight.

    Row weights scale the emission part of the gradient; steps between labels count evenly. Deterministic.
    """
    n = max(1, len(x))
    emit, step = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
    gold = np.eye(2)[labels]
    inner = np.ones(len(x), bool)
    inner[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[at - 1], labels[at]), 1)
    moments = [np.zeros(emit.size + 4), np.zeros(emit.size + 4)]
    for i in range(1, rounds + 1):
        p, steps, _ = forward_backward(Crf(emit, step), x, lengths)
        slope = np.concatenate([(x.T @ ((gold - p) * weights[:, None])).ravel(), (seen - steps).ravel()]) / n
        slope -= decay * np.concatenate([emit.ravel(), step.ravel()])
        moments = [0.9 * moments[0] + 0.1 * slope, 0.99 * moments[1] + 0.01 * slope**2]
        move = rate * (moments[0] / (1 - 0.9**i)) / (np.sqrt(moments[1] / (1 - 0.99**i)) + 1e-8)
        emit = emit + move[:-4].reshape(emit.shape)
        step = step + move[-4:].reshape(2, 2)
    return Crf(emit, step)


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, decay: float = 1e-3) -> np.ndarray:
    """Weights of a logistic model, by Newton steps; x holds a column of ones."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) / len(y) - decay * w
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(y) + decay * np.eye(len(w))
        w = w + np.linalg.solve(curve, slope)
    return w
