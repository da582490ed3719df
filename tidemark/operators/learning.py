"""Recurrences that learn as they go: regimes, kernel regression, centroids, ensemble weights, evidence.

Same contract as ``recursive``: step(state, inputs) -> (state, outputs), state a JSON-able list.
Vector inputs arrive as separate columns.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np

from tidemark.operators.recursive import Recurrence

# ---- regimes ----
# fixed values: persistence and first emissions of the adaptive filter, and of the learning one
STICKY = ((0.95, 0.025, 0.025), (0.025, 0.95, 0.025), (0.10, 0.10, 0.80))
FIRST = ((0.001, -0.001, 0.0), (0.010, 0.020, 0.005))
LEARNING = ((0.95, 0.025, 0.025), (0.025, 0.95, 0.025), (0.05, 0.05, 0.90))
LEARNING_FIRST = ((0.001, -0.001, 0.0), (0.01, 0.02, 0.015))


def _density(x: float, mean: float, std: float) -> float:
    return math.exp(-0.5 * ((x - mean) / std) ** 2) / (std * math.sqrt(2 * math.pi))


def _refit(seen: list[float]) -> list[list[float]]:
    """Means and deviations of the upper 40 %, lower 40 % and middle of the sorted returns."""
    s, n = np.sort(seen), len(seen)
    parts = (s[int(0.6 * n) :], s[: int(0.4 * n)], s[int(0.4 * n) : int(0.6 * n)])
    return [[float(p.mean()) for p in parts], [max(float(p.std()), 0.001) for p in parts]]


def _adaptive(lookback: int, every: int, s, x):
    p, count, changes, before, emit, seen = s or [[1 / 3] * 3, 0, 0, None, [list(v) for v in FIRST], []]
    (r,) = x
    prior = np.array(p) @ np.array(STICKY)
    joint = prior * [max(_density(r, m, d), 1e-10) for m, d in zip(*emit)]
    p = (joint / joint.sum()).tolist() if joint.sum() > 1e-10 else [1 / 3] * 3
    state = p.index(max(p))
    changes += before is not None and state != before
    seen, count = [*seen, r][-lookback:], count + 1
    if count % every == 0 and len(seen) >= lookback:
        emit = _refit(seen)
    return [p, count, changes, state, emit, seen], (*p, float(state), max(p), float(changes))


def adaptive_regimes(ret: str = "ret", lookback: int = 200, every: int = 50) -> Recurrence:
    """Forward filter whose emissions are refitted to quantiles of recent returns."""
    return Recurrence(partial(_adaptive, lookback, every), (ret,), ("a_bull", "a_bear", "a_range", "a_state", "a_confidence", "a_changes"))


def _learned(rate: float, s, x):
    logs, means, stds = s or [[math.log(1 / 3)] * 3, *[list(v) for v in LEARNING_FIRST]]
    (r,) = x
    # log-sum-exp over the state before, then the emission
    terms = np.array(logs)[:, None] + np.log(np.array(LEARNING))
    top = terms.max(axis=0)
    logs = top + np.log(np.exp(terms - top).sum(axis=0)) + [-0.5 * ((r - m) / d) ** 2 - math.log(d) - 0.5 * math.log(2 * math.pi) for m, d in zip(means, stds)]
    logs = logs - (logs.max() + math.log(np.exp(logs - logs.max()).sum()))
    p = np.exp(logs)
    p = p / p.sum()
    w = rate * p
    means = (1 - w) * means + w * r
    stds = np.sqrt(np.maximum((1 - w) * np.square(stds) + w * np.square(r - means), 1e-6))
    stability = (p.max() - 1 / 3) / (2 / 3)
    ahead = p @ np.array(LEARNING)
    return [logs.tolist(), means.tolist(), stds.tolist()], (*p.tolist(), float(p.argmax()), float(stability), *ahead.tolist())


def learned_regimes(ret: str = "ret", rate: float = 0.01) -> Recurrence:
    """Log-space forward filter that learns its emissions; stability and the next state's odds."""
    return Recurrence(partial(_learned, rate), (ret,), ("l_bull", "l_bear", "l_range", "l_state", "l_stability", "l_next_bull", "l_next_bear", "l_next_range"))


# ---- kernel regression ----


def kernel(kind: str, sigma: float, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Kernel of each row of x with y: rbf, poly (cubic) or linear."""
    if kind == "rbf":
        return np.exp(-((x - y) ** 2).sum(axis=-1) / (2 * sigma * sigma))
    return (x @ y + 1) ** 3 if kind == "poly" else x @ y


def _krls(kind: str, forget: float, novelty: float, most: int, adapt: float, s, x):
    y, v = x[-1], np.array(x[:-1], float)
    if s is None:
        return [[v.tolist()], [y], [[1.0]], 1.0, 0.0], (0.0, y, 1.0)
    words, alpha, inverse, sigma, mean_error = s
    words, alpha, inverse = np.array(words), np.array(alpha), np.array(inverse)
    k = kernel(kind, sigma, words, v)
    guess = float(alpha @ k)
    error = y - guess
    a = inverse @ k
    delta = float(kernel(kind, sigma, v[None], v)[0] - k @ a)
    inverse = inverse / forget
    if delta > novelty and len(words) < most:
        # a new word: the inverse grows by a block
        grown = np.zeros((len(words) + 1, len(words) + 1))
        grown[:-1, :-1] = inverse + np.outer(a, a) / delta
        grown[:-1, -1] = grown[-1, :-1] = -a / delta
        grown[-1, -1] = 1 / delta
        alpha = np.append(alpha - a * error / delta, error / delta)
        words, inverse = np.vstack([words, v]), grown
    else:
        alpha = alpha + error * a / (1 + a @ a)
    if adapt:
        mean_error = 0.9 * mean_error + 0.1 * abs(error)
        sigma = min(10.0, max(0.1, sigma * (1 + adapt if abs(error) > mean_error else 1 - adapt)))
    return [words.tolist(), alpha.tolist(), inverse.tolist(), sigma, mean_error], (guess, error, float(len(words)))


def kernel_regression(inputs: tuple[str, ...], target: str, kind: str = "rbf", forget: float = 0.99, novelty: float = 0.1, most: int = 200, adapt: float = 0.0) -> Recurrence:
    """Kernel recursive least squares with a novelty dictionary: prediction, error, words; ``adapt`` lets the width follow errors.

    A dictionary of ``most`` words takes no more; ``pruned`` makes room when asked.
    """
    return Recurrence(partial(_krls, kind, forget, novelty, most, adapt), (*inputs, target), ("krls", "krls_error", "krls_words"))


def pruned(state: list, keep: int | None = None, kind: str = "rbf") -> list:
    """A kernel regression's state cut to the words of largest weight (0.8 of them unless told), its inverse rebuilt under the same kernel."""
    words, alpha, _, sigma, mean_error = state
    keep = int(0.8 * len(words)) if keep is None else keep
    if len(words) <= keep:
        return state
    order = sorted(sorted(range(len(alpha)), key=lambda i: -abs(alpha[i]))[:keep])
    w = np.array(words)[order]
    gram = np.array([kernel(kind, sigma, w, v) for v in w]) + 1e-6 * np.eye(len(w))
    return [w.tolist(), np.array(alpha)[order].tolist(), np.linalg.inv(gram).tolist(), sigma, mean_error]


# ---- centroids ----


def _centroid_step(first: list[list[float]], labels: list[int], lorentz: bool, rate: float, s, x):
    centroids, counts, marks = s or [[list(c) for c in first], [0] * len(first), list(labels)]
    v, label = np.array(x[:-1], float), x[-1]
    known = label is not None and label == label
    c = np.array(centroids)
    d = np.log1p(np.abs(c - v)).sum(axis=1) if lorentz else ((c - v) ** 2).sum(axis=1)
    if lorentz:  # only centroids of the same label move
        d = np.where(np.array(marks) == label, d, np.inf)
    i = int(d.argmin())
    if np.isfinite(d[i]):
        step = rate if lorentz else 1 / (1 + counts[i] * rate)
        centroids[i] = ((1 - step) * c[i] + step * v).tolist()
        counts[i] += 1
        if known and not lorentz:
            marks[i] = int(round(0.95 * marks[i] + 0.05 * label))
    return [centroids, counts, marks], (float(i), float(d[i]) if np.isfinite(d[i]) else None)


def moving_centroids(inputs: tuple[str, ...], label: str, first: list[list[float]], labels: list[int], lorentz: bool = False, rate: float = 0.01) -> Recurrence:
    """Online centroids: Euclidean with a fading rate, or Lorentzian within the row's label at a fixed rate."""
    return Recurrence(partial(_centroid_step, first, labels, lorentz, rate), (*inputs, label), ("centroid", "centroid_distance"))


# ---- ensemble weights ----


def _ensemble(rate: float, s, x):
    p, label = np.array(x[:-1], float), x[-1]
    w, b = s or [[1.0] * len(p), 0.0]
    clipped = np.clip(p, 0.01, 0.99)
    out = 1 / (1 + math.exp(-(float(np.dot(w, np.log(clipped / (1 - clipped)))) + b)))
    error = out - label
    share = np.abs(w) / max(float(np.abs(w).sum()), 1e-12)
    w = np.clip(np.array(w) - rate * error * p, -5, 5)
    b = min(2.0, max(-2.0, b - rate * error))
    return [w.tolist(), b], (out, error, float(share.max()))


def learned_ensemble(inputs: tuple[str, ...], label: str, rate: float = 0.01) -> Recurrence:
    """Logistic pooling whose weights follow the outcomes (the gradient reads the probabilities themselves)."""
    return Recurrence(partial(_ensemble, rate), (*inputs, label), ("pooled", "pooled_error", "top_importance"))


def _weights(rate: float, s, x):
    s, _ = _ensemble(rate, s, x)
    return s, tuple(s[0])


def ensemble_weights(inputs: tuple[str, ...], label: str, rate: float = 0.01) -> Recurrence:
    """The weights themselves after each outcome."""
    return Recurrence(partial(_weights, rate), (*inputs, label), tuple(f"weight_{i + 1}" for i in range(len(inputs))))


# ---- evidence ----


def _evidence(decay: float, floor: float, s, x):
    bull, bear = x
    new = [bull, bear, 0.0, 0.0, 0.0, 0.0, max(0.0, 1 - bull - bear)]
    if s is None:
        return new, (new[0], new[1], 0.0)
    # old evidence fades into the frame; what has grown tiny goes
    old = [m * (1 - decay) for m in s[:6]]
    old = [m if m >= floor else 0.0 for m in old]
    old.append(1 - sum(old))
    cells = [0.0] * 8
    for i, a in enumerate(old, 1):
        for j, b in enumerate(new, 1):
            cells[i & j] += a * b
    conflict = cells[0]
    m = [c / (1 - conflict) for c in cells[1:]] if conflict < 1 - 1e-12 else [0.0] * 6 + [1.0]
    return m, (m[0], m[1], conflict)


def fading_evidence(bull: str, bear: str, decay: float = 0.1, floor: float = 0.001) -> Recurrence:
    """Dempster's rule over time with decay: beliefs and conflict."""
    return Recurrence(partial(_evidence, decay, floor), (bull, bear), ("bel_bull", "bel_bear", "evidence_conflict"))


# ---- learnable averages ----


def _gradient_ema(rate: float, first: float, s, x):
    (z,) = x
    logit = math.log(first / (1 - first))
    if s is None:
        return [z, logit], (z, first)
    y, logit = s
    alpha = 1 / (1 + math.exp(-logit))
    error = z - y
    # the average's derivative in its logit is error * alpha * (1 - alpha): a step against the squared error
    logit = min(4.0, max(-4.0, logit + rate * error * error * alpha * (1 - alpha)))
    y = y + alpha * error
    return [y, logit], (y, alpha)


def learnable_ema(x: str = "close", period: int = 20, rate: float = 0.01) -> Recurrence:
    """EMA whose smoothing is a sigmoid of a logit moved by gradient steps, held within +/-4."""
    return Recurrence(partial(_gradient_ema, rate, 2 / (period + 1)), (x,), ("learned_ema", "learned_alpha"))
