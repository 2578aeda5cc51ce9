"""Quality by naive Bayes support vectors.

n-gram indicators are scaled by the log ratio of their smoothed shares in the two classes, and a linear hinge-loss model is
fitted on the scaled indicators by dual coordinate descent. n-grams are of three kinds: byte trigrams, words, and shapes of
words (case, last character, whether the word or the one before it repeats), one to three in a row. A logistic curve on
rows that the model was not fitted on turns margins into scores; as the rows of the lower class are few, both classes
weigh alike in the hinge loss.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import mix, table
from .linear import fold, grams, indices, scored, sigmoid, trained, training_rows
from .words import word_hashes

BITS = 20
SMOOTH, COST, EPOCHS = 1.0, 0.1, 12
THRESHOLD = 0.7
_A, _B = 1 << BITS, (1 << BITS) + 1
_KIND = np.array([1 if 65 <= c <= 90 else 2 if 97 <= c <= 122 else 3 if 48 <= c <= 57 else 4 if c >= 128 else 100 + c for c in range(256)], np.uint64)


def features(text: bytes) -> np.ndarray:
    words = text.split()
    if not words:
        return np.empty(0, np.int32)
    b = np.frombuffer(text, np.uint8).astype(np.uint64)
    w = word_hashes(text)
    joined = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(x) + 1 for x in words]) - 2
    starts = np.concatenate([[0], ends[:-1] + 2])
    again = np.zeros(len(w), np.uint64)
    again[1:] += w[1:] == w[:-1]
    again[2:] += 2 * (w[2:] == w[:-2]).astype(np.uint64)
    second = np.minimum(starts + 1, ends)
    shape = mix(_KIND[joined[starts]] * np.uint64(1 << 24) + _KIND[joined[second]] * np.uint64(1 << 16) + _KIND[joined[ends]] * np.uint64(8) + again)
    # how many of the words differ, in eighths, for texts of about this length
    share = int(8 * len(np.unique(w)) / len(w)) + 16 * min(15, len(w).bit_length())
    return indices([grams(b, (0, 1, 2), 1), grams(w, (0,), 2), grams(shape, (0,), 3), grams(shape, (0, 1), 4), grams(shape, (0, 1, 2), 5), mix(np.array([share], np.uint64) + np.uint64(1 << 40))], BITS)


def log_ratios(xs: list[np.ndarray], ys: np.ndarray) -> np.ndarray:
    """For each feature the log ratio of its smoothed shares in the two classes; 0 for those of a single row, which says nothing about others."""
    counts = np.zeros((2, 1 << BITS))
    for x, y in zip(xs, ys, strict=True):
        counts[y, x] += 1
    share = (counts + SMOOTH) / (np.array([(ys == c).sum() for c in (0, 1)])[:, None] + 2 * SMOOTH)
    return np.where(counts.sum(0) > 1, np.log(share[1] / share[0]), 0.0)


def descended(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, cost: np.ndarray, size: int, epochs: int = EPOCHS) -> tuple[np.ndarray, float, np.ndarray]:
    """(weights, bias, dual variables) of the linear hinge-loss model by dual coordinate descent.

    ``rows`` are (indices, values) of length 1; the bias is one more coordinate, so each row's square is 2.
    """
    w, bias, alpha, order = np.zeros(size), 0.0, np.zeros(len(rows)), np.arange(len(rows))
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        rng.shuffle(order)
        for i in order:
            x, v = rows[i]
            gradient = signs[i] * (float(w[x] @ v) + bias) - 1
            new = min(max(alpha[i] - gradient / 2.0, 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * signs[i]
                w[x] += step * v
                bias += step
                alpha[i] = new
    return w, bias, alpha


def nb_svm(xs: list[np.ndarray], ys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Features with their scaled weights and squared ratios; under the last two numbers the curve's slope and offset."""
    fit = np.arange(len(xs)) % 5 != 4
    ratio = log_ratios([x for x, use in zip(xs, fit, strict=True) if use], ys[fit])
    rows = []
    for x in xs:
        x = x[ratio[x] != 0]
        rows.append((x, ratio[x] / max(1e-9, float(np.linalg.norm(ratio[x])))))
    some = [max(1, int((ys[fit] == c).sum())) for c in (0, 1)]
    cost = np.array([COST * sum(some) / (2 * some[c]) * 10 for c in (0, 1)])
    at = np.flatnonzero(fit)
    w, bias, _ = descended([rows[i] for i in at], 2 * ys[at] - 1, cost[ys[at]], 1 << BITS)
    margins = np.array([float(w[x] @ v) + bias for x, v in rows])
    a, b = _logistic(margins[~fit], ys[~fit])
    at = np.flatnonzero(ratio)
    return np.append(at, [_A, _B]), np.append((w * ratio)[at], [a, b + a * bias]), np.append(ratio[at] ** 2, [0, 0])


def curve(weight: float, norm: float, slope: float, offset: float) -> float:
    return sigmoid(slope * weight / max(1e-9, norm**0.5) + offset)


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the likeliest curve, with Platt's smoothed targets, by Newton's method."""
    pos, neg = int(y.sum()), int(len(y) - y.sum())
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -35, 35)))
        g = np.array([((p - t) * m).sum() + 1e-6 * a, (p - t).sum()])
        d = p * (1 - p)
        h = np.array([[(d * m * m).sum() + 1e-6, (d * m).sum()], [(d * m).sum(), d.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs; learned from the labels outside the held-out fold.

    Null and empty texts get the curve's offset; texts of any length are scored whole; without any label every score is 0.5;
    rows that repeat an id are scored one by one; a score equal to the threshold is predicted 1; an empty table gives an empty
    result; columns other than doc_id and text are ignored.
    """
    rows, shift = training_rows(docs, labels, "quality", 4, 2)
    at, w, v = trained(rows, features, nb_svm)
    slope, offset = float(w[at == _A].sum()), float(w[at == _B].sum()) + shift
    keep = at < _A
    return scored(docs, fold("doc_id", 4, 2), THRESHOLD, features, 1 << BITS, (at[keep], w[keep], v[keep]), lambda s, n: curve(s, n, slope, offset))


def query(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
